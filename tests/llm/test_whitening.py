"""Whitening against numpy on the distinct vectors, exact sums of large integers, and odd rows."""

import random
from math import prod

import numpy as np
import pytest

from millrace.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<double>"


def rows_of(n, dims=6, seed=4, size=1.0):
    r = random.Random(seed)
    return [(k, [r.gauss(0, size * (d + 1)) for d in range(dims)]) for k in range(n)]


def check(spark, rows, components=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as id", "2 as x", "3 as n", "4 as component", "5 as r")
    got = W.whitened(df).collect()
    whole = [(k, [int(np.floor(256 * c)) for c in v]) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in whole}), np.float64)
    n, mean = len(fit), fit.mean(0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, q = np.linalg.eigh(cov)
    shown = min(components, fit.shape[1])
    assert len(got) == len(whole) * shown and {r.n for r in got} == {n}
    sums = [int(s) for s in fit.sum(0)]
    exact = sorted((k is None, k or 0, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for k, v in whole)
    assert exact == sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in got if r.component == 1)
    for k in range(1, shown + 1):
        own = [r for r in got if r.component == k]
        assert all(abs(r.explained / (e[-k] / cov.trace()) - 1) < 1e-6 for r in own)
        want = {i: float((np.array(v) - mean) @ q[:, -k] / np.sqrt(e[-k])) for i, v in whole}
        if len(want) == len(own):
            sign = 1 if sum(r.whitened * want[r.vec_id] for r in own) > 0 else -1
            assert all(abs(r.whitened - sign * want[r.vec_id]) < 1e-6 for r in own)
    assert all(r.identity_error < 1e-6 for r in got)


def test_same_as_numpy(spark):
    check(spark, rows_of(200))
    check(spark, rows_of(50, dims=2))


def test_repeats_count_once_for_the_fit(spark):
    rows = rows_of(40)
    check(spark, rows + [(100 + k, rows[0][1]) for k in range(300)] + rows[:5])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, rows_of(30) + [(50, None), (51, []), (52, [1.0] * 5 + [None]), (53, [nan] * 6), (54, [inf] + [0.0] * 5), (None, [0.5] * 6), (None, [-0.0] * 6)])


def test_scatter_is_exact_for_large_integers(spark):
    r = random.Random(5)
    x = [[r.randrange(-(1 << 61), 1 << 61) for _ in range(3)] for _ in range(50)]
    got = W.scatter(spark.createDataFrame([(v,) for v in x], "x array<bigint>").repartition(4), 3, 50, 1 << 61)
    assert got.n == 50 and got.sums == [sum(v[i] for v in x) for i in range(3)]
    assert got.products == [[sum(v[i] * v[j] for v in x) for j in range(3)] for i in range(3)]


def test_residues_come_back():
    moduli = W.primes(1 << 70)
    assert prod(moduli) > 1 << 70 and all(p % 2 and p < 1 << W.PRIME_BITS for p in moduli)
    values = [0, 1, -1, 1 << 68, -(1 << 68), 12345678901234567890]
    assert W.recombined([np.array([v % p for v in values]) for p in moduli], moduli) == values
    assert W.BLOCK * (1 << 2 * W.PRIME_BITS) <= 1 << 53


def test_large_offsets_lose_nothing(spark):
    """A mean a million times the spread: the covariance is that of the spread."""
    rows = [(k, [1e6 + c for c in v]) for k, v in rows_of(60, dims=4)]
    near = W.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.identity_error < 1e-4 for r in near)


def test_deviation_beyond_a_long_is_null(spark):
    got = W.whitened(spark.createDataFrame([(1, [1e7, 0.0]), (2, [-1e7, 1.0])], SCHEMA)).collect()
    assert {r.deviation for r in got} == {None}
    assert all(abs(r.identity_error) < 1e-4 for r in got)


def test_no_variance_and_no_rows(spark):
    one = W.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = W.whitened(spark.createDataFrame([(k, [float(k), 5.0]) for k in range(9)], SCHEMA)).collect()
    assert {r.whitened is None for r in flat if r.component == 2} == {True} and all(r.whitened is not None for r in flat if r.component == 1)
    none = W.whitened(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(ValueError):
        W.whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))
