"""Vector codes against Lloyd's rounds in plain Python, and odd rows."""

import random
from hashlib import sha256

import numpy as np
import pytest

from millrace.llm import pq

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts, entries, rounds, scale):
    """{vec_id: (code, error)} and the codebooks, every part against every entry in every round."""
    kept = [(k, [int(np.floor(np.float64(np.float32(c)) * scale)) for c in v]) for k, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[cut[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for row in cut:
                groups.setdefault(near(row[p], books[p])[1], []).append(row[p])
            for e, own in groups.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    coded = [[near(row[p], books[p]) for p in range(parts)] for row in cut]
    return [(k, "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c)) for (k, _), c in zip(kept, coded, strict=True)], books


def compare(spark, rows, **options):
    o = {"parts": 4, "entries": 5, "rounds": 4, "scale": 64} | options
    got = pq.compressed(spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as id", "2 as x", "3 as state", "4 as sums", "5 as own"), **o).collect()
    want, books = plain(rows, **o)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r.vec_id, r.code, r.error) for r in got], key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in got} == {sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()}
    return got


def vectors(n, dims=8, seed=1, spread=1.0):
    r = random.Random(seed)
    return [(k, [r.gauss(0, spread) for _ in range(dims)], k % 3 or None) for k in range(n)]


def test_same_as_plain_rounds(spark):
    got = compare(spark, vectors(300))
    labels = {k: label for k, _, label in vectors(300)}
    sums = {}
    for r in got:
        sums[labels[r.vec_id]] = sums.get(labels[r.vec_id], 0) + r.error
    assert all(r.label_error == sums[labels[r.vec_id]] for r in got) and len(sums) == 3


def test_ties_and_repeats(spark):
    r = random.Random(2)
    rows = [(k, [float(r.randrange(-1, 2)) for _ in range(8)], 0) for k in range(200)]  # many equal parts and equal distances
    compare(spark, rows + [(500 + k, [0.0] * 8, 1) for k in range(100)] + rows[:20], scale=3)


def test_bounds_save_scans_and_change_nothing(spark):
    r = random.Random(3)
    centres = [[r.gauss(0, 10) for _ in range(8)] for _ in range(5)]
    rows = [(k, [c + r.gauss(0, 0.05) for c in centres[k % 5]], 0) for k in range(400)]
    trained = pq.train(spark.createDataFrame(rows, SCHEMA), parts=4, entries=5, rounds=4, scale=64)
    assert trained.scans[0] == 1600 and max(trained.scans[1:]) < 160
    compare(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(50, None, 1), (51, [], 1), (52, [1.0] * 7 + [None], 1), (53, [1.0] * 7 + [nan], 1), (54, [-inf] + [1.0] * 7, 1), (None, [0.5] * 8, None), (None, [0.25] * 8, None), (3, [9.0] * 8, 2)]
    assert len(compare(spark, vectors(40) + odd)) == 43
    assert len(compare(spark, vectors(3))) == 3  # fewer rows than entries
    assert len(compare(spark, vectors(1))) == 1
    compare(spark, vectors(30), rounds=0)


def test_empty_and_refused(spark):
    none = pq.compressed(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for rows in ([(1, [1.0] * 8, 0), (2, [1.0] * 16, 0)], [(1, [1.0] * 6, 0)], [(1, [1e9] * 8, 0)]):
        with pytest.raises(ValueError):
            pq.compressed(spark.createDataFrame(rows, SCHEMA))


def test_outward_rounding():
    x = np.array([1 / 3, 2 / 3, 1.0, 1e-30, 123456789.123])
    assert (pq._outward(x, True).astype(np.float64) >= x).all() and (pq._outward(x, False).astype(np.float64) <= x).all()
