"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, everything but letters counts as a space, two spaces
stand before and behind it. Its 2- and 3-grams are hashed to BUCKETS features.
The matrix of log probabilities, languages by buckets, is broadcast; a batch is
scored by gathering from it for every n-gram and summing by document.

Above SLICE_LANGS languages the matrix is cut into slices of so many, in order of
name: each is learned, broadcast and scored by itself, and a document carries
its best language so far and the sum of the shares. Results are those of one
matrix. A slice costs a pass to learn and one to score, so a column full of junk
labels takes long; the driver holds the name and count of every label.

Defined cases: a null text or one without a letter is `und` with score 0; a
null language isn't learned from; nothing to learn from gives `und` for all;
ties go to the language that sorts first; equal texts score equally, repeated
rows stay; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, lean, remove, spread, text_slices, written

BUCKETS = 1 << 15
#: About so many documents of each language are learned from; all count for the priors.
FIT_DOCS = 5_000
#: Languages of a slice; the matrix that every task gets has a row for each.
SLICE_LANGS = 256
#: Long texts are scored in windows of so many characters, which overlap by two.
CHUNK = 1_000_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _chunks(texts: list[str | None]) -> tuple[list[str], list[int]]:
    """Padded texts in pieces of CHUNK n-gram starts, and the text each is of."""
    pieces, owner = [], []
    for k, t in enumerate(texts):
        if t:
            t = f"  {t.lower()}  "
            for a in range(0, len(t) - 2, CHUNK):
                pieces.append(t[a : a + CHUNK + 2])
                owner.append(k)
    return pieces, owner


def hashed_ngrams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the 2-gram, of the 3-gram at each start; bounds of pieces; letters by piece).

    Starts run over all pieces joined; the last two of each piece belong to none.
    """
    cp = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[cp]
    cp = np.where(is_letter, cp, np.uint32(32)).astype(np.uint64)
    a, b, c = cp[:-2], cp[1:-1], cp[2:]
    mixed = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    shift = np.uint64(64 - 15)
    two = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift
    mixed = mixed + c * np.uint64(0x165667B19E3779F9) + np.uint64(1)
    three = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> shift
    ends = np.cumsum([len(p) for p in pieces])
    starts = np.concatenate([[0], ends[:-1]])
    letters = np.add.reduceat(is_letter, starts, dtype=np.int64)
    return two.astype(np.int32), three.astype(np.int32), np.stack([starts, ends - 2], 1), letters


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # languages x BUCKETS
    log_prior: np.ndarray
    further: tuple[Callable[[], Model], ...] = ()  # the models of the languages behind these, each learned when it is called

    def parts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(best language, its log probability, all languages' probabilities over its own) of each text; `und` has a mass of 0."""
        lang, top, mass = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        pieces, owner = _chunks(texts)
        if not pieces or not self.langs:
            return lang, top, mass
        two, three, bounds, letters = hashed_ngrams(pieces)
        total, seen = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        np.add.at(seen, owner, letters)
        for k, row in enumerate(self.log_prob):
            each = np.append(row[two] + row[three], 0.0)  # the last piece may end behind the last n-gram
            sums = np.add.reduceat(each, bounds.ravel())[::2]
            np.add.at(total[:, k], owner, sums)
        total += self.log_prior
        highest, best = total.max(1), total.argmax(1)
        sums = np.exp(total - highest[:, None]).sum(1)
        for k in np.flatnonzero(seen):
            lang[k], top[k], mass[k] = self.langs[best[k]], highest[k], sums[k]
        return lang, top, mass

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, _, mass = self.parts(texts)
        return lang, shares(mass)


def shares(mass: np.ndarray) -> np.ndarray:
    return np.array([round(1.0 / m, 9) if m else 0.0 for m in mass.tolist()])


def better(before: tuple[list[str], np.ndarray, np.ndarray], then: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Parts of two slices together; the former keeps ties."""
    (lang, top, mass), (lang2, top2, mass2) = before, then
    wins = top2 > top
    apart = np.exp(-np.abs(top2 - top))
    langs = [b if w else a for a, b, w in zip(lang, lang2, wins.tolist(), strict=True)]
    return langs, np.where(wins, top2, top), np.where(wins, mass2 + mass * apart, mass + mass2 * apart)


def _count(pairs: Iterator[tuple[list[str | None], list[str]]]) -> Iterator[tuple[str, np.ndarray]]:
    counts: dict[str, np.ndarray] = {}
    for texts, langs in pairs:
        pieces, owner = _chunks(texts)
        if pieces:
            two, three, bounds, _ = hashed_ngrams(pieces)
            for (i, j), k in zip(bounds.tolist(), owner, strict=True):
                row = counts.setdefault(langs[k], np.zeros(BUCKETS, np.int64))
                row += np.bincount(two[i:j], minlength=BUCKETS)
                row += np.bincount(three[i:j], minlength=BUCKETS)
    yield from counts.items()


def fit(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> Model:
    """Learns from text and lang of the rows whose crc32(id) mod 5 isn't 0."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator())
    if not n:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    slices = [partial(_learned, rows, dict(n[k : k + SLICE_LANGS]), sum(v for _, v in n), fit_docs) for k in range(0, len(n), SLICE_LANGS)]
    first = slices[0]()
    first.further = tuple(slices[1:])
    return first


def _learned(rows: DataFrame, n: dict[str, int], docs: int, fit_docs: int) -> Model:
    """The model of some languages, n documents of each and docs of all, from rows (id, text, lang)."""
    share = F.lit(0)
    for k, v in n.items():
        share = F.when(F.col("lang") == k, F.lit(int(min(1.0, fit_docs / v) * 2**30))).otherwise(share)
    taken = rows.filter(F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(2**30)) < share).select("text", "lang")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[list, list]]:
            for b in batches:
                for i, j, texts in text_slices(b, 300_000):
                    yield texts, b.column("lang").slice(i, j - i).to_pylist()

        for k, row in _count(pairs()):
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])

    found = taken.mapInArrow(lean(run), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(n)
    counts = np.zeros((len(langs), BUCKETS))
    place = {k: i for i, k in enumerate(langs)}
    counts[[place[k] for k in found["lang"].to_pylist()], found["bucket"].to_numpy()] = found["n"].to_numpy()
    counts += 0.5
    return Model(langs, np.log(counts / counts.sum(1, keepdims=True)), np.log(np.array([n[k] for k in langs], float) / docs))


def predict(df: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row."""
    slim = spread(df.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text).alias("text")))
    if model.further:
        return _by_slices(slim, model).withColumnRenamed("id", id_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in text_slices(b):
                lang, score = shared.value.score(texts)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("held_out").slice(i, j - i), pa.array(lang, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    return slim.mapInArrow(lean(run), f"id {id_type}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def _by_slices(slim: DataFrame, model: Model) -> DataFrame:
    """(id, held_out, lang_pred, score) of rows (id, held_out, text), a written pass for each slice of languages."""
    rows = slim.withColumns({"lang_pred": F.lit(UNKNOWN), "top": F.lit(0.0), "mass": F.lit(0.0)})
    schema, last = rows.schema, None
    for make in (lambda: model, *model.further):
        part = make()
        shared = slim.sparkSession.sparkContext.broadcast(Model(part.langs, part.log_prob, part.log_prior))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j, texts in text_slices(b):
                    cut = b.slice(i, j - i)
                    here = shared.value.parts(texts)
                    before = cut.column("lang_pred").to_pylist(), cut.column("top").to_numpy(), cut.column("mass").to_numpy()
                    lang, top, mass = better(before, here) if before[2].any() else here
                    yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in ("id", "held_out", "text")), pa.array(lang, pa.string()), pa.array(top), pa.array(mass)], schema.names)

        rows = written(rows.mapInArrow(lean(run), schema), "languages")
        shared.destroy()
        if last is not None:
            remove(last)
        last = rows
    share = F.when(F.col("mass") > 0, F.round(1.0 / F.col("mass"), 9)).otherwise(0.0)
    return rows.select("id", "held_out", "lang_pred", share.alias("score"))
