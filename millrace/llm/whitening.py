"""Embedding whitening from an exact scatter in residue numbers.

Vectors become integers; each distinct one counts once for the fit. Their scatter
(sums of products of all pairs of components, of components, and their number) is
made as a product of residue matrices for each of several primes, by blocks so
small that float64 products and sums of residues are exact integers. Tasks give
one row of residues each, Spark adds them up, and the driver puts the sums, a
few thousand numbers whatever the rows, together by the Chinese remainder
theorem. There are as many primes as the largest possible sum asks for, so the
scatter is exact, and so is the covariance times n squared; only its division and
the eigenvectors are of double precision.

Defined cases: rows whose vector is null, empty or holds a null or non-finite
component are left out; repeated rows and rows without an id are given as they
come; an empty table gives no row; vectors shorter than four have as many
components; a component without variance (one distinct vector, or constant or
dependent positions) has whitened null and no part in identity_error, and
explained is null where the trace is 0; a deviation beyond a long is null; other
columns are ignored, whatever their names. Vectors of several lengths and
components beyond longs are refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import prod
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, remove, spread, written
from .wholevec import element, matrix, scaled, shape

COMPONENTS, SCALE = 4, 256
#: Primes lie below 2**PRIME_BITS; products of BLOCK residues of each pair sum up below 2**53.
PRIME_BITS, BLOCK = 20, 4096
#: Rows that one step of the last pass takes.
ROWS = 4096


def primes(above: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS, as many as make a product above `above`."""
    sieve = np.ones(1 << PRIME_BITS, bool)
    sieve[:2] = False
    for k in range(2, 1 << PRIME_BITS // 2):
        if sieve[k]:
            sieve[k * k :: k] = False
    found, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > above:
            break
        found.append(p)
        product *= p
    return found


def recombined(residues: list[np.ndarray], moduli: list[int]) -> list[int]:
    """The integers between minus and plus half the product of the moduli that have these residues."""
    product = prod(moduli)
    total = [0] * len(residues[0])
    for r, p in zip(residues, moduli, strict=True):
        unit = product // p * pow(product // p, -1, p)
        total = [t + int(x) * unit for t, x in zip(total, r.tolist(), strict=True)]
    return [t - product if 2 * t > product else t for t in (t % product for t in total)]


def residues(x: np.ndarray, moduli: list[int]) -> np.ndarray:
    """(primes, pairs): the scatter of rows x, with a one at the end of each, modulo each prime; pairs of the upper triangle."""
    dims = x.shape[1] + 1
    upper = np.triu_indices(dims)
    out = np.zeros((len(moduli), len(upper[0])), np.int64)
    for k in range(0, len(x), BLOCK):
        block = np.concatenate([x[k : k + BLOCK], np.ones((len(x[k : k + BLOCK]), 1), np.int64)], 1)
        for i, p in enumerate(moduli):
            r = (block % p).astype(np.float64)
            out[i] = (out[i] + (r.T @ r)[upper].astype(np.int64)) % p
    return out


class Scatter(NamedTuple):
    n: int
    sums: list[int]
    products: list[list[int]]


def scatter(fit: DataFrame, dims: int, rows: int, most: int) -> Scatter:
    """Exact sums over the rows of fit (x)."""
    moduli = primes(2 * rows * max(most, 1) ** 2 + 1)
    pairs = (dims + 1) * (dims + 2) // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), pairs), np.int64)
        for b in batches:
            total = (total + residues(matrix(b.column("x"), dims), moduli)) % np.array(moduli)[:, None]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], ["r"])

    each = fit.select("x").mapInArrow(lean(run), "r array<bigint>").select(F.posexplode("r").alias("pos", "r")).groupBy("pos").agg(F.sum("r").alias("r")).toArrow()  # pairs x primes
    flat = np.zeros(len(moduli) * pairs, np.int64)
    flat[each["pos"].to_numpy()] = each["r"].to_numpy()
    found = recombined([r % p for r, p in zip(flat.reshape(len(moduli), -1), moduli, strict=True)], moduli)
    whole = [[0] * (dims + 1) for _ in range(dims + 1)]
    for (i, j), v in zip(np.transpose(np.triu_indices(dims + 1)).tolist(), found, strict=True):
        whole[i][j] = whole[j][i] = v
    return Scatter(whole[dims][dims], whole[dims][:dims], [row[:dims] for row in whole[:dims]])


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    axes: np.ndarray  # (dims, components), scaled to unit variance; NaN where there is none
    explained: list[float | None]


def fitted(s: Scatter, components: int = COMPONENTS) -> Whitening:
    dims = len(s.sums)
    cov = np.array([[(s.n * s.products[i][j] - s.sums[i] * s.sums[j]) / s.n**2 for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    trace, floor = float(np.trace(cov)), max(values[-1], 0.0) * dims * np.finfo(np.float64).eps
    axes, explained = [], []
    for k in range(1, min(components, dims) + 1):
        e = float(values[-k])
        axes.append(vectors[:, -k] / np.sqrt(e) if e > floor else np.full(dims, np.nan))
        explained.append(max(e, 0.0) / trace if trace > 0 else None)
    return Whitening(s.n, s.sums, np.stack(axes, 1), explained)


def _projected(x: np.ndarray, w: Whitening) -> np.ndarray:
    return (x - np.array([s / w.n for s in w.sums])) @ w.axes


def _deviations(x: np.ndarray, w: Whitening, most: int) -> pa.Array:
    """Sums of (n * x - S) ** 2, null beyond a long."""
    dims = x.shape[1]
    if 4 * dims * (w.n * max(most, 1)) ** 2 < 1 << 63:
        d = w.n * x - np.array(w.sums, np.int64)
        return pa.array(np.einsum("ij,ij->i", d, d))
    exact = [sum((w.n * c - s) ** 2 for c, s in zip(row, w.sums, strict=True)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def identity_error(fit: DataFrame, w: Whitening, dims: int) -> float | None:
    """The largest absolute entry of the covariance of fit's whitened rows minus the identity."""
    live = np.flatnonzero(~np.isnan(w.axes).any(0)).tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _projected(matrix(b.column("x"), dims), w)
            yield pa.RecordBatch.from_arrays([pa.array(y[:, k]) for k in live], [f"w{k}" for k in live])

    if not live:
        return None
    pairs = [(i, j) for i in live for j in live if i <= j]
    y = fit.select("x").mapInArrow(lean(run), ", ".join(f"w{k} double" for k in live))
    got = y.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()  # centred while it sums
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, got, strict=True))


def whitened(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row with a whole vector and every component."""
    kind = dict(df.dtypes)[key]
    fields = f"id {kind}, component int, deviation bigint, whitened double, explained double"
    rows = scaled(spread(df), vector, scale, id=key)
    size = shape(rows)
    if not size.rows:
        none = df.sparkSession.createDataFrame([], f"{fields}, n bigint, identity_error double")
        return none.select(F.col("id").alias(key), "component", "n", "deviation", "whitened", "explained", "identity_error")
    rows = rows.withColumn("x", F.col("x").cast(f"array<{element(size.most)}>"))
    fit = written(rows.select("x").distinct(), "distinct")  # repeats meet before the shuffle
    w = fitted(scatter(fit, size.dims, size.rows, size.most), components)
    error = identity_error(fit, w, size.dims)
    remove(fit)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = w.axes.shape[1]
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                x = matrix(b.column("x"), size.dims)
                y = _projected(x, w).ravel()
                each = np.repeat(np.arange(len(x)), shown)
                number = np.tile(np.arange(1, shown + 1, dtype=np.int32), len(x))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(each)), pa.array(number), _deviations(x, w, size.most).take(pa.array(each)), pa.array(y, mask=np.isnan(y)), pa.array(w.explained * len(x), pa.float64())],
                    ["id", "component", "deviation", "whitened", "explained"],
                )

    out = rows.mapInArrow(lean(run), fields)
    return out.select(F.col("id").alias(key), "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
