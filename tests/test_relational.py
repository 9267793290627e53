"""Operators by ranges: against plain Python, with one key that holds all rows, nulls, ties and a caller's columns of any name."""

import random
from collections import Counter

import oracle
import pytest
from pyspark.sql import functions as F

from millrace.operators import ranges as G
from millrace.operators import relational as R
from millrace.plans import catalog

LARGER = "/root/testdata/sf0.01"
EXTRA = "7 as _cell, 8 as _new, 9 as _part, 'a' as _k, 'b' as _t, 'c' as _v, 'd' as _row, 'e' as before, 'f' as level"
NAMES = EXTRA.replace(",", "").split()[2::3]


@pytest.mark.parametrize("name", "join_as_of sessionize join_range join_range_wide join_overlap window_rank aggregate_percentile sort_total join_full".split())
def test_same_as_sql_on_larger_tables(spark, name):
    assert oracle.differences(catalog.QUERIES[name](spark, LARGER), oracle.duck(LARGER), catalog.ORACLE_SQL[name]) == []


def one_key(spark, n, parts=4):
    return spark.range(n).repartition(parts).select(F.lit("k").alias("key"), F.expr("timestamp_seconds(id * 60 + (id div 50) * 7200)").alias("at"), F.col("id").alias("v"), F.expr("id % 5 = 0").alias("is_right")).selectExpr("*", *EXTRA.split(", "))


def spread_over(rows):
    """Rows of each task that has some."""
    return sorted(rows.groupBy(F.spark_partition_id()).count().toPandas()["count"])


def test_one_key_is_spread_over_all_tasks(spark):
    sizes = spread_over(G.dealt(one_key(spark, 4000), ("key",), ["at"]))
    assert sum(sizes) == 4000 and len(sizes) >= 4 and max(sizes) < 2000
    for df in (R.sessions(one_key(spark, 4000), "key", "at", 3600), R.ranks(one_key(spark, 4000), ("key",), [F.col("at")], 3), R.as_of_join(one_key(spark, 4000), one_key(spark, 9), "key", "at", "v", "seen")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all(G.PART in w or "sum(__n#" in w for w in windows)  # by range, or over ranges' totals
        assert set(NAMES) <= set(df.columns)


def test_as_of_with_one_key(spark):
    df = one_key(spark, 1000)
    got = R.as_of_join(df, df.filter("is_right"), "key", "at", "v", "seen").collect()
    assert len(got) == 1000 and all(r.seen == r.v // 5 * 5 and r._cell == 7 and r._row == "d" for r in got)


def test_as_of_nulls_and_ties(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", None, "y"), (None, 5, "z"), ("a", 0, "w"), ("b", 9, "v"), ("a", 5, "x")], "key string, at int, id string")
    right = spark.createDataFrame([("a", 1, 10), ("a", 5, 20), ("a", 5, 30), ("a", 5, None), (None, 1, 40), ("a", None, 50), ("b", 10, 60)], "key string, at int, v int")
    got = Counter((r.id, r.seen) for r in R.as_of_join(left, right, "key", "at", "v", "seen").collect())
    assert got == Counter({("x", 30): 2, ("y", None): 1, ("z", None): 1, ("w", None): 1, ("v", None): 1})
    assert R.as_of_join(left.limit(0), right, "key", "at", "v", "seen").count() == 0
    with pytest.raises(ValueError):
        R.as_of_join(left, right, "key", "at", "v", "id")


def test_sessions_with_one_key_and_gaps_between_ranges(spark):
    got = R.sessions(one_key(spark, 1000), "key", "at", 3600).collect()
    assert all(r.session == r.v // 50 for r in got) and len(got) == 1000
    odd = spark.createDataFrame([("a", None, 1), ("a", 100, 2), ("a", 100, 3), ("a", 9000, 4), (None, 5, 5), (None, 99999, 6)], "key string, s bigint, id int").withColumn("at", F.expr("timestamp_seconds(s)"))
    assert {r.id: r.session for r in R.sessions(odd, "key", "at", 3600).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 1}
    assert R.sessions(odd.limit(0), "key", "at", 3600).count() == 0


def test_ranks_against_windows(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, 1, 2, 3, r.randrange(50)]), k) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5).selectExpr("*", *EXTRA.split(", "))
    df.createOrReplaceTempView("ranked")
    order = [F.asc_nulls_last("v"), F.col("id")]
    want = spark.sql("SELECT id, row_number() OVER w rn, rank() OVER v rk, dense_rank() OVER v dr, percent_rank() OVER v pr, cume_dist() OVER v cd, ntile(7) OVER w nt FROM ranked WINDOW w AS (PARTITION BY g ORDER BY v NULLS LAST, id), v AS (PARTITION BY g ORDER BY v NULLS LAST)")
    numbered = {x.id: (x.row_number, x.ntile) for x in R.ranks(df, ("g",), order, 7).collect()}
    tied = {x.id: (x.rank, x.dense_rank, round(x.percent_rank, 9), round(x.cume_dist, 9)) for x in R.ranks(df, ("g",), order[:1], 7).collect()}
    assert numbered == {x.id: (x.rn, x.nt) for x in want.collect()}
    assert tied == {x.id: (x.rk, x.dr, round(x.pr, 9), round(x.cd, 9)) for x in want.collect()}
    few = R.ranks(df.limit(3), (), [F.col("id")], 7).collect()
    assert sorted(x.ntile for x in few) == [1, 2, 3] and R.ranks(df.limit(0), ("g",), order, 7).count() == 0


def test_percentiles_against_spark(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(r.choice(["a", "a", None, "b"]), r.choice([None, 5.0, 5.0, r.random() * 9])) for _ in range(500)] + [("none", None), ("one", 3.0)], "g string, v double")
    shares = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "high": 1.0}
    want = df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items()])
    key = lambda rows: {x.g: [x[n] is not None and round(x[n], 9) for n in shares] for x in rows}
    assert key(R.percentiles(df, ("g",), "v", shares).collect()) == key(want.collect())
    assert R.percentiles(df.limit(0), ("g",), "v", shares).count() == 0
    plan = R.percentiles(df, ("g",), "v", shares)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan


def wide(seed, n):
    r = random.Random(seed)
    out = [(k, r.uniform(-1e6, 1e6)) for k in range(n)]
    return [(k, low, low + 10 ** r.uniform(0, 7)) for k, low in out] + [(n, 5.0, 5.0), (n + 1, 9.0, 1.0), (n + 2, None, 1.0), (n + 3, 0.0, None), (n + 4, float("nan"), 1.0), (n + 5, -8.0, 8.0), (n + 6, float("-inf"), 0.0), (n + 7, 0.0, float("inf"))]


def fits(a, b):
    return a is not None and b is not None and a == a and b == b and a < b


def test_range_join_of_any_width(spark):
    r = random.Random(3)
    ranges, points = wide(4, 150), [(k, r.uniform(-2e6, 2e6)) for k in range(300)] + [(900, None), (901, -8.0), (902, 8.0), (903, 0.0)]
    p, s = spark.createDataFrame(points, "p int, x double").selectExpr("*", *EXTRA.split(", ")), spark.createDataFrame(ranges, "r int, low double, high double")
    got = Counter((x.p, x.r) for x in R.range_join(p, s, "x", "low", "high").collect())
    assert got == Counter((k, j) for k, x in points if x is not None for j, a, b in ranges if fits(a, b) and a <= x < b)
    levels = R._levels(s, "low", "high")
    assert len(levels) <= 14  # even powers of two from 1 to 10**7, and one without end
    cells = s.filter("low < high").select(F.size(R._cells("low", "high", R._level("low", "high")))).collect()
    assert {c[0] for c in cells} <= {1, 2}
    assert R.range_join(p, s.limit(0), "x", "low", "high").count() == 0 and set(NAMES) <= set(R.range_join(p, s, "x", "low", "high").columns)


def test_overlaps_of_any_width(spark):
    a, b = wide(5, 120), [(k, x, y) for k, x, y in wide(6, 90)]
    left, right = spark.createDataFrame(a, "l int, low double, high double"), spark.createDataFrame(b, "r int, begins double, ends double")
    got = Counter((x.l, x.r) for x in R.overlap_join(left, right, "low", "high", "begins", "ends").collect())
    assert got == Counter((k, j) for k, p, q in a if fits(p, q) for j, u, v in b if fits(u, v) and p < v and u < q)
    assert R.overlap_join(left.limit(0), right, "low", "high", "begins", "ends").count() == 0


def test_names_are_not_overwritten(spark):
    df = spark.createDataFrame([(1, 2, "x")], "g int, v int, rank string")
    for f in (lambda: R.top_k(df, "g", [F.col("v")], 1), lambda: R.ranks(df, ("g",), [F.col("v")], 2), lambda: R.places(df, [F.col("v")], "rank")):
        with pytest.raises(ValueError):
            f()
    assert R.top_k(df, "g", [F.col("v")], 1, "nth").first().asDict() == {"g": 1, "v": 2, "rank": "x", "nth": 1}
