"""Vector code compression: product quantization whose codebooks are trained by Hamerly's form of Lloyd's rounds, in integers.

A vector is cut into equal parts, each part position with a codebook of its own.
Every round's table holds, for each vector and part, the assigned entry, an upper
bound of the distance to it and a lower bound of the distance to the nearest
other entry. When entries move, the upper bound grows by its entry's move and the
lower one shrinks by the largest move of the others. Only where the upper bound is
not strictly below the lower one, even after it was set to the exact distance,
are all entries gone through, in integers, ties to the lower index. Bounds are
rounded outwards, so that a skipped scan could not have found another entry.

Each round is one pass over the table before, which writes vectors and bounds
anew and a row of sums for each task; sums are added up by Spark and only they
(parts x entries x (components + 1) numbers) come to the driver. A lost executor
costs its tasks, not the rounds before.

Defined cases: rows whose vector is null, empty or holds a null or non-finite
component are left out; rows without an id count, after all others, as do
repeated rows, each for itself; rows of one id are ordered by their vectors; with
fewer rows than entries the codebooks have as many entries as rows; an empty
table gives no row; null labels are one label; other columns are ignored,
whatever their names. Vectors of several lengths, or of a length that parts don't
divide, and components beyond exact integer distances are refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, remove, spread, written
from .wholevec import element, matrix, scaled, shape

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that one step of a kernel takes.
ROWS = 2048
#: More than the rounding of a few float64 operations.
WIDER = 1 + 2.0**-40


class Trained(NamedTuple):
    books: np.ndarray  # (parts, entries, components) of int64
    table: DataFrame  # written: (id, label, x, state) with the bounds of the last round
    moves: np.ndarray  # (parts, entries): how far entries have moved since
    scans: list[int]  # parts whose entries all were gone through, by round


def _outward(x: np.ndarray, up: bool) -> np.ndarray:
    """float32 at or beyond x."""
    y = x.astype(np.float32)
    wrong = y < x if up else y > x
    return np.where(wrong, np.nextafter(y, np.float32(np.inf if up else -np.inf)), y)


def _distances(x: np.ndarray, books: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distances of parts x (rows, components) to all entries of the codebooks `which`."""
    out = np.empty((len(x), books.shape[1]), np.int64)
    for e in range(books.shape[1]):
        d = x - books[which, e]
        out[:, e] = np.einsum("ij,ij->i", d, d)
    return out


def _assigned(x: np.ndarray, books: np.ndarray, moves: np.ndarray, before: list[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower) of every part of x (rows, parts, components), and how many parts were scanned in full."""
    rows, parts, _ = x.shape
    entries = books.shape[1]
    part = np.broadcast_to(np.arange(parts), (rows, parts))
    if before is None:
        code = np.zeros((rows, parts), np.uint8)
        upper, lower = np.full((rows, parts), np.inf, np.float32), np.zeros((rows, parts), np.float32)
        open_ = np.ones((rows, parts), bool)
    else:
        packed = np.frombuffer(b"".join(before), np.uint8).reshape(rows, parts * 9)
        code = packed[:, :parts].copy()
        upper, lower = (np.ascontiguousarray(packed[:, parts * k : parts * (k + 4)]).view(np.float32) for k in (1, 5))
        order = np.sort(moves, 1)
        top, second = order[:, -1], order[:, -2] if entries > 1 else order[:, -1]
        own = moves[part, code]
        others = np.where(own == top[part], second[part], top[part])  # at least the largest move of the others
        upper = _outward((upper.astype(np.float64) + own) * WIDER, True)
        lower = _outward((lower.astype(np.float64) - others) * np.where(lower > others, 2 - WIDER, WIDER), False)
        open_ = ~(upper < lower)
        d = x[open_] - books[part[open_], code[open_]]
        upper[open_] = _outward(np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64)) * WIDER, True)
        open_ &= ~(upper < lower)
    if open_.any():
        d = _distances(x[open_], books, part[open_])
        best = d.argmin(1)
        nearest = d[np.arange(len(d)), best]
        code[open_], upper[open_] = best, _outward(np.sqrt(nearest.astype(np.float64)) * WIDER, True)
        if entries > 1:
            d[np.arange(len(d)), best] = np.iinfo(np.int64).max
            lower[open_] = _outward(np.sqrt(d.min(1).astype(np.float64)) * (2 - WIDER), False)
        else:
            lower[open_] = np.inf
    return code, upper, lower, int(open_.sum())


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def _round(rows: DataFrame, books: np.ndarray, moves: np.ndarray, dims: int) -> DataFrame:
    """rows (id, label, x, state) with new states, and after those of each task a row of sums: parts x entries x (components.., count), then the scans."""
    parts, entries, width = books.shape
    first = "state" not in rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scans, kept, none = np.zeros((parts * entries, width + 1), np.int64), 0, None, None
        for b in _slices(batches):
            x = matrix(b.column("x"), dims).reshape(-1, parts, width)
            code, upper, lower, more = _assigned(x, books, moves, None if first else b.column("state").to_pylist())
            scans += more
            at = (np.arange(parts) * entries + code).ravel()
            sums[:, width] += np.bincount(at, minlength=parts * entries)
            order = np.argsort(at, kind="stable")
            at, flat = at[order], x.reshape(-1, width)[order]
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums[at[begins], :width] += np.add.reduceat(flat, begins, 0)
            state = np.concatenate([code, upper.view(np.uint8).reshape(len(x), -1), lower.view(np.uint8).reshape(len(x), -1)], 1)
            kept = b.select(["id", "label", "x"])
            none = kept.slice(0, 0)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([s.tobytes() for s in state], pa.binary()), pa.nulls(len(x), pa.list_(pa.int64()))], ["id", "label", "x", "state", "sums"])
        if none is not None:
            last = [pa.nulls(1, f.type) for f in none.schema]
            yield pa.RecordBatch.from_arrays([*last, pa.nulls(1, pa.binary()), pa.array([[*sums.ravel().tolist(), scans]], pa.list_(pa.int64()))], ["id", "label", "x", "state", "sums"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lean(run), f"id {kinds['id']}, label {kinds['label']}, x {kinds['x']}, state binary, sums array<bigint>")


def _totals(table: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(sums, counts, scans) over all tasks."""
    parts, entries, width = books.shape
    each = table.filter("sums is not null").select(F.posexplode("sums").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).toArrow()  # a few thousand numbers
    flat = np.zeros(parts * entries * (width + 1) + 1, np.int64)
    flat[each["pos"].to_numpy()] = each["n"].to_numpy()
    both = flat[:-1].reshape(parts, entries, width + 1)
    return both[:, :, :width], both[:, :, width], int(flat[-1])


def train(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Trained | None:
    """Codebooks after `rounds` rounds from those of the smallest ids; None without a row."""
    rows = scaled(spread(df), vector, scale, id=key, label=label)
    size = shape(rows)
    if not size.rows:
        return None
    if size.dims % parts:
        raise ValueError(f"{parts} parts don't divide {size.dims} components")
    if 4 * size.most**2 * size.dims >= 1 << 63:
        raise ValueError("components are too large for exact distances")
    rows = rows.withColumn("x", F.col("x").cast(f"array<{element(size.most)}>"))
    first = rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).toArrow()
    books = matrix(first["x"].combine_chunks(), size.dims).reshape(-1, parts, size.dims // parts).transpose(1, 0, 2).copy()
    table, moves, scans = None, np.zeros(books.shape[:2]), []
    for _ in range(rounds):
        last, table = table, written(_round(rows if table is None else table.filter("sums is null").drop("sums"), books, moves, size.dims), "codes")
        if last is not None:
            remove(last)
        sums, counts, scanned = _totals(table, books)
        scans.append(scanned)
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        moves = np.sqrt(((new - books) ** 2).sum(2).astype(np.float64)) * WIDER
        books = new
    return Trained(books, rows if table is None else table, moves, scans)


def _coded(trained: Trained) -> DataFrame:
    """(id, label, code, error) by the trained codebooks."""
    books, table, moves, _ = trained
    parts, _, width = books.shape
    first = "state" not in table.columns
    rows = table if first else table.filter("sums is null").drop("sums")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x = matrix(b.column("x"), parts * width).reshape(-1, parts, width)
            code = _assigned(x, books, moves, None if first else b.column("state").to_pylist())[0]
            d = x - books[np.arange(parts), code]
            error = np.einsum("ijk,ijk->i", d, d)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lean(run), f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def digest(books: np.ndarray) -> str:
    """Of all components by part, entry and position."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row with a whole vector."""
    trained = train(df, vector, key, label, parts, entries, rounds, scale)
    if trained is None:
        return df.sparkSession.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = written(_coded(trained), "coded")
    if rounds:
        remove(trained.table)
    by_label = written(coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("own")))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest(trained.books)).alias("codebooks_sha256"))
