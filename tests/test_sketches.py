"""Stored sketches merged over parts, against the same made at once, and odd values."""

import oracle
import pytest
from pyspark.sql import functions as F

from millrace.operators import sketches as K
from millrace.plans import catalog

LARGER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["sketch_merge", "sketch_sets", "sketch_top_words"])
def test_within_the_stated_errors(spark, name):
    assert oracle.differences(catalog.QUERIES[name](spark, LARGER), oracle.duck(LARGER), catalog.ORACLE_SQL[name]) == []


def test_merging_is_the_same_as_sketching_at_once(spark):
    df = spark.range(50_000).select((F.col("id") % 40).alias("day"), (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 30_011).alias("v"), F.col("id").cast("double").alias("x"))
    once, later = K.stored(df, ("g",), "v", "x"), K.merged(K.stored(df, ("day", "g"), "v", "x"), ("g",))
    size = lambda t: {r[0]: r[1:] for r in t.select("g", F.theta_sketch_estimate("theta"), F.kll_sketch_get_n_double("kll"), F.hll_sketch_estimate("hll")).collect()}
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    for t in (once, later):
        assert all(abs(size(t)[g][0] - n) <= K.THETA_ERROR * n and abs(size(t)[g][2] - n) <= K.HLL_ERROR * n for g, n in exact.items())
    assert {g: s[1] for g, s in size(once).items()} == {g: s[1] for g, s in size(later).items()}


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", None, None), ("b", None, None), (None, 2, 2.0)], "g string, v bigint, x double")
    got = {r[0]: r[1] for r in K.merged(K.stored(df, ("g",), "v", "x"), ("g",)).select("g", F.hll_sketch_estimate("hll")).collect()}
    assert got == {"a": 1, "b": 0, None: 1}
    assert K.merged(K.stored(df.limit(0), ("g",), "v", "x"), ("g",)).count() == 0
    top = K.top_items(K.frequent_items(df, ("g",), "v", 10), 2, 10).collect()
    assert {(r.item, r["count"]) for r in top if r.item is not None} == {(1, 1), (2, 1)} or len(top) == 2
