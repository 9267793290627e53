"""Queries that take whole tables: against their SQL at a size where a subset of ids would show."""

import os
import re

import oracle
import pytest
from pyspark.sql import functions as F

from millrace.operators import relational
from millrace.plans import catalog
from millrace.streaming import windows

LARGER = os.environ.get("TEST_LARGER_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(LARGER)


def rows(con, table):
    return con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]


def test_math_takes_all_lines(spark, con):
    df = catalog.QUERIES["scalar_math"](spark, LARGER)
    assert oracle.differences(df, con, catalog.ORACLE_SQL["scalar_math"]) == []
    assert df.count() == rows(con, "lineitem")


@pytest.mark.parametrize("name", ["union_all", "union", "intersect", "intersect_all", "except", "except_all"])
def test_sets_take_all_customers(spark, con, name):
    df = catalog.QUERIES[f"set_{name}"](spark, LARGER)
    assert oracle.differences(df, con, catalog.ORACLE_SQL[f"set_{name}"]) == []
    if name == "union_all":
        assert df.count() == rows(con, "supplier") + rows(con, "customer")


def test_sort_places_all_parts(spark, con):
    df = catalog.QUERIES["sort_total"](spark, LARGER)
    assert oracle.differences(df, con, catalog.ORACLE_SQL["sort_total"]) == []
    assert df.count() == rows(con, "part")


def test_places_with_nulls_ties_and_none(spark):
    values = [3, None, 1, 3, 2, None, 1]
    df = spark.createDataFrame(list(enumerate(values)), "k bigint, v bigint")
    got = {r.k: r.place for r in relational.places(df, [F.asc_nulls_last("v"), F.col("k")]).collect()}
    order = sorted(range(len(values)), key=lambda k: (values[k] is None, values[k] or 0, k))
    assert got == {k: at for at, k in enumerate(order, 1)}
    assert relational.places(df.filter("k < 0"), [F.col("k")]).count() == 0


@pytest.mark.parametrize("name", ["ngrams", "tokenize_bytes", "pack_stream"])
def test_documents_pass_through(spark, con, name):
    assert oracle.differences(catalog.QUERIES[name](spark, LARGER), con, catalog.ORACLE_SQL[name]) == []


def test_stream_flushes_what_is_left_of_several_batches(spark, tmp_path):
    runs = [[("a", 5), ("b", 8)], [("a", 1), ("a", 9)], [("b", 8)]]
    for rows_ in runs:
        spark.createDataFrame(rows_, "source string, n bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, n bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = windows.flushed(windows.finished(windows.pack_stream(stream, 8, rest=True), "append")).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 8), ("a", 1, 7), ("b", 0, 8), ("b", 1, 8)]


def test_no_query_keeps_a_range_of_ids():
    """Bounds on a key column would make a query run on a subset; comparisons of keys with other columns don't."""
    bound = re.compile(r"\b(?:[a-z]{1,2}_\w*key|doc_id|vec_id|page_id|event_id|conv_id|user_id)\s*(?:<=?|BETWEEN)\s*\d", re.IGNORECASE)
    assert {name: m.group() for name, sql in catalog.ORACLE_SQL.items() if (m := bound.search(sql))} == {}


@pytest.mark.parametrize("name", ["join_full", "math_density", "math_answer"])
def test_all_rows_of_joins_and_answers(spark, con, name):
    assert oracle.differences(catalog.QUERIES[name](spark, LARGER), con, catalog.ORACLE_SQL[name]) == []
