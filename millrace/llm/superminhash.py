"""Near duplicates by SuperMinHash signatures: banding, verification on full sets, union-find grouping.

SuperMinHash (Ertl 2017): an element draws, for step j = 0, 1, .., a number r_j
and the j-th place of a random permutation of the signature's places, and offers
j + r_j there; each place keeps the smallest offer of all elements. An element so
reaches every place once, in an order of its own, which makes places depend on
each other and signatures vary less than those of independent hashes. Later steps
offer larger numbers, so a set is done when all its places hold less than the
step's number: large sets after two or three steps. Many sets are worked on at
once, step by step, those that are done dropping out.

A signature is cut into BANDS bands of BAND_ROWS places; sets with an equal band
meet in a cell. Of two sets with similarity s the chance to meet nowhere is
(1 - s ** BAND_ROWS) ** BANDS at most: 2e-8 at 0.85, and less above. What meets is
bounded by counts, verified on the full sets and grouped as in the n-gram join,
whose rounds keep groups of thousands of copies cheap: pairs of a home are joined
by union-find where they are found, components of links over homes by
alternating star steps, which are a union-find for edge tables.

Defined cases: null and empty texts and texts without a word have no shingle and
are linked with nothing; equal sets are one point; rows that share an id are one
node, repeated rows are all kept or none; a row without an id has no component
and kept is null; an empty table gives no row; other columns are ignored,
whatever their names. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, lean, remove, spread, text_slices, written
from .ngram_join import _point, grouped
from .shingles import mixed, shingle_sets

WORDS, PERCENT = 5, 85
BANDS, BAND_ROWS = 24, 4
_U = np.uint64
#: Offers are step << FRACTION | a random fraction.
FRACTION = 48
_SEED = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Elements whose permutations are held at once.
ELEMENTS = 100_000


def signatures(sets: list[np.ndarray], places: int = BANDS * BAND_ROWS) -> np.ndarray:
    """(sets, places) of uint64: the SuperMinHash of each set of distinct 64-bit elements; of an empty one the largest value throughout."""
    out = np.full((len(sets), places), _MASK, _U)
    sizes = np.array([len(s) for s in sets], np.int64)
    doc, e = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.zeros(0, _U)
    order = np.tile(np.arange(places, dtype=np.uint16 if places > 256 else np.uint8), (len(e), 1))
    flat = out.reshape(-1)
    for j in range(places):
        live = out.max(1) >= _U(j << FRACTION)
        going = live[doc]
        if not going.all():
            doc, e, order = doc[going], e[going], order[going]
        if not len(e):
            break
        x = mixed(e ^ mixed(np.array([(j + 1) * _SEED & _MASK], _U)))
        k = j + ((x & _U(0xFFFFFFFF)) * _U(places - j) >> _U(32)).astype(np.int64)
        at = np.arange(len(e))
        place = order[at, k].astype(np.int64)
        order[at, k] = order[:, j]
        np.minimum.at(flat, doc * places + place, _U(j << FRACTION) | (x >> _U(64 - FRACTION)))
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """(sets, bands) of int64: a hash of each band's number and places."""
    cut = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=_U)), cut.shape[:2])
    for r in range(rows):
        key = mixed(key * _U(_SEED) ^ cut[:, :, r])
    return key.view(np.int64)


def _parts(sets: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The sets, about ELEMENTS elements at a time."""
    begin = size = 0
    for k, s in enumerate(sets):
        if k > begin and size + len(s) > ELEMENTS:
            yield sets[begin:k]
            begin, size = k, 0
        size += len(s)
    yield sets[begin:]


def sketched(df: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(id, n, h1, h2, point, keys) of rows (id, text): the size of the set, a hash of it, its counts by group and its bands' keys, none for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in text_slices(b):
                sets = shingle_sets(texts, words)
                both = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                keys = np.concatenate([band_keys(signatures(part, bands * rows), bands, rows) for part in _parts(sets)])
                n = np.array([len(s) for s in sets], np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                cols = [b.column("id").slice(i, j - i), pa.array(n), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([_point(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].ravel()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "h1", "h2", "point", "keys"])

    return df.mapInArrow(lean(run), "id bigint, n bigint, h1 bigint, h2 bigint, point binary, keys array<bigint>")


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: the smallest id that links lead to, and whether it is the row's own."""
    importable(df.sparkSession)
    docs = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")))
    sketches = written(sketched(docs, words, bands, rows), "sketches")
    classes = written(sketches.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep")), "classes")
    reps = sketches.join(classes.select("h1", "h2", F.col("rep").alias("id")), ["h1", "h2", "id"], "left_semi").dropDuplicates(["id", "h1", "h2"])
    each = written(reps.select("id", F.explode("keys").alias("cell")), "bands")
    cells = written(each.groupBy("cell").agg(F.count("*").alias("many")).filter("many > 1"), "cells")
    members = written(each.join(cells, "cell").withColumn("lead", F.lit(True)), "members")
    remove(each, cells)
    out = grouped(docs, sketches, classes, reps, members, words, percent)
    return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_col)
