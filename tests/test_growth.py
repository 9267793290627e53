"""Queries whose steps grew faster than their input: the same results as by pairs, odd values, and plans without the step."""

import datetime
import random
import re
from collections import Counter

import oracle
import pandas as pd
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.operators import vectors
from millrace.plans import catalog
from millrace.streaming import arrivals, stateful
from millrace.streaming import windows as S


def folder(spark, tmp_path, **tables):
    """The folder of a few tables; DuckDB reads them as views."""
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def same(spark, d, name, *tables, text=False):
    """What differs from the SQL; as text, values that are not a number are equal."""
    con = oracle.duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    df, sql = catalog.QUERIES[name](spark, d), catalog.ORACLE_SQL[name]
    if not text:
        return oracle.differences(df, con, sql)
    rows = lambda found, names: Counter(str([oracle.plain(r[names.index(c)]) for c in sorted(names)]) for r in found)
    want = con.execute(sql)
    mine, other = rows(df.collect(), df.columns), rows(want.fetchall(), [c[0] for c in want.description])
    return [mine - other, other - mine] if mine != other else []


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")


def test_overlaps_are_counted_without_pairs(spark, tmp_path):
    r, day = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(k, day + datetime.timedelta(seconds=r.randrange(4000)), r.randrange(40), r.choice(["error", "view", "click"]), r.choice([0.0, 7.5, 900.0, -1.0, -1.5, -300.0, None]), "{}") for k in range(900)]
    rows += [(5, day, 3, "error", 2.0, "{}"), (2000, None, 3, "error", 2.0, "{}"), (2001, None, 99, "view", 1.0, "{}"), (None, day, 2, "error", 4.0, "{}")]
    d = folder(spark, tmp_path, events=events(spark, rows))
    assert same(spark, d, "join_overlap", "events") == []  # errors of negative length too
    plan = catalog.QUERIES["join_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__cell" not in plan  # no row meets the others of its cell


def test_overlap_totals_of_odd_rows(spark):
    left = spark.createDataFrame([(0, 10, 1), (10, 20, 2), (5, 5, 4), (9, 3, 8), (None, 3, 16), (12, 13, None), (-5, 30, -32)], "a bigint, b bigint, v bigint")
    right = spark.createDataFrame([("x", 10, 11), ("y", 20, 5), ("z", 40, 50), ("x", 0, 1), (None, 0, 99), ("n", None, 4), ("e", 12, 12), ("f", 10, 10)], "k string, c bigint, d bigint")
    a, b = [x for x in map(tuple, left.collect()) if None not in x[:2] and x[0] < x[1]], list(map(tuple, right.collect()))
    want = {}
    for k, c, e in b:
        for low, high, v in a:
            if c is not None and e is not None and low < e and c < high:
                n, s = want.get(k, (0, 0))
                want[k] = (n + 1, s + (v or 0))
    got = {x.k: (x.n, x.total) for x in R.overlap_totals(left, right, "a", "b", "c", "d", "k", "v").collect()}
    assert got == want and R.overlap_totals(left.limit(0), right, "a", "b", "c", "d", "k", "v").count() == 0


def test_range_least_without_pairs(spark):
    r = random.Random(8)
    nan, inf = float("nan"), float("inf")
    for size in (0, 1, 2, 37, 256):
        points = [(r.randrange(9999), r.choice([None, nan, inf, -0.0, 0.0, *[float(r.randrange(-50, 200)) for _ in range(9)]])) for _ in range(size)]
        ranges = [(r.randrange(80), low, None if low is None else low + r.choice([0.0, -3.0, 0.5, 1.0, 20.0, 1e7])) for low in [None, nan, -inf, 0.0, -0.0, *[float(r.randrange(-60, 210)) for _ in range(140)]]]
        p, s = spark.createDataFrame(points, "s bigint, x double"), spark.createDataFrame(ranges, "k bigint, low double, high double")
        want = {}
        for k, low, high in ranges:
            for i, x in points:
                if None not in (x, low, high) and low <= x < high:
                    n, least = want.get(k, (0, i))
                    want[k] = (n + 1, min(least, i))
        assert {x.k: (x.n, x.least) for x in R.range_least(p, s, "x", "s", "low", "high", "k").collect()} == want


def test_wide_ranges_meet_cells_not_points(spark):
    """2,000 ranges over all of 2,000 points: by pairs 4 million rows, here cells by power of two."""
    p, s = spark.range(2000).selectExpr("id AS s", "CAST(id * 3 AS DOUBLE) AS x"), spark.range(2000).selectExpr("id AS k", "-1.0D - id AS low", "1e9D AS high")
    out = R.range_least(p, s, "x", "s", "low", "high", "k")
    assert [tuple(x) for x in out.groupBy("n", "least").count().collect()] == [(2000, 0, 2000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__cell" in plan and not re.search(r"\bx#", plan)  # points meet no range


def test_nearest_by_products_of_matrices(spark, tmp_path, monkeypatch):
    """Copies, near copies and odd vectors in tiles of a few rows, against the SQL; plain ones meet no pair in Spark."""
    r, nan = random.Random(9), float("nan")
    centre = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(k, [x + (k % 3) * r.gauss(0, 1e-6) for x in centre[k % 6]] if k % 4 else [r.gauss(0, 1) for _ in range(8)]) for k in range(700)]
    odd = [None, [], [0.0] * 8, [1.0, None, *[0.5] * 6], [nan] * 8, [1.0, 2.0], [None] * 8, [1.0] * 9]
    schema = "vec_id bigint, embedding array<float>, label int"
    monkeypatch.setattr(vectors, "TILE", 64)
    for name, table in (("plain", rows), ("odd", [*rows, *zip([701, 702, 703, 704, 705, 706, 707, 750], odd, strict=True), (800, [0.0] * 8), (850, [1.0, 2.0]), (None, [1.0] * 8)])):
        d = folder(spark, tmp_path / name, embeddings=spark.createDataFrame([(*t, 0) for t in table], schema))
        assert same(spark, d, "nearest_vectors", "embeddings", text=True) == [], name
    plan = catalog.QUERIES["nearest_vectors"](spark, str(tmp_path / "plain"))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Join" not in plan


def test_means_do_not_go_by_the_order_of_rows(spark, tmp_path):
    """The group's mean is the value of one of its events, and sums in some orders miss it; odd values are as in the SQL."""
    values = [9.64, 132.19, 42.74, 56.99, 65.17, 39.27, 0.4, 19.34, 13.2, 52.04, 37.53, 2.73]
    day, got = datetime.datetime(2024, 1, 1), set()
    for turn in range(12):
        rows = [(k, day, 1, "purchase", v, "{}") for k, v in enumerate(values[turn:] + values[:turn])]
        d = folder(spark, tmp_path / str(turn), events=events(spark, rows))
        got.add(next(r.above for r in catalog.QUERIES["apply_pandas"](spark, d).collect() if rows[r.event_id][4] == 39.27))
    assert got == {False}
    odd = [("a", None), ("a", 1.0), ("b", None), ("c", 1.0), ("c", float("nan")), ("d", float("inf")), ("d", 1.0), ("e", float("inf")), ("e", float("-inf")), (None, 2.0), (None, 4.0)]
    d = folder(spark, tmp_path / "odd", events=events(spark, [(k, day, 1, t, v, "{}") for k, (t, v) in enumerate(odd)]))
    assert same(spark, d, "apply_pandas", "events") == []


def test_encodings_of_long_and_odd_addresses(spark, tmp_path):
    urls = ["https://www.example.com/" + "a" * 90, "x" * 57, "x" * 58, "a*b~c d+e%2A%7E%2B", "é中😀-_.!'()", "", None, "a\r\nb"]
    d = folder(spark, tmp_path, pages=spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"))
    assert same(spark, d, "scalar_encoding", "pages") == []


def test_first_orders_with_nulls_and_foreign_views(spark, tmp_path):
    customers = spark.range(6).selectExpr("id AS c_custkey", "'x' AS c_name", "1 AS c_nationkey", "1.0D AS c_acctbal", "'m' AS c_mktsegment")
    rows = [(None, 0, 9.0), (7, 0, 9.0), (1, 0, 3.0), (2, 1, None), (3, 1, 1.0), (4, 2, float("nan")), (5, 2, 1e9), (6, 3, None), (None, 3, None), (8, None, 1.0)]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_totalprice double").selectExpr("*", "'F' AS o_orderstatus", "TIMESTAMP_NTZ'2024-01-01' AS o_orderdate", "'1' AS o_orderpriority")
    d = folder(spark, tmp_path, customer=customers, orders=orders)
    for name in ("v_customer", "v_orders"):
        spark.range(3).createOrReplaceTempView(name)
    assert same(spark, d, "join_lateral", "customer", "orders") == []
    assert same(spark, d, "subqueries", "customer", "orders") == []
    assert spark.table("v_customer").columns == spark.table("v_orders").columns == ["id"]  # a caller's views stay


def test_no_sketch_is_kept_for_each_row(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(k // 2, day, 1, [None, "a", "b"][k % 3], float(k % 97), "{}") for k in range(3000)] + [(None, day, 1, "a", 5.0, "{}")]
    d = folder(spark, tmp_path, events=events(spark, rows))
    assert same(spark, d, "aggregate_sketches", "events") == []
    plan = catalog.QUERIES["aggregate_sketches"](spark, d)._jdf.queryExecution().executedPlan().toString()
    sketched = [line for line in plan.splitlines() if "sketch" in line and "Aggregate(" in line]
    assert sketched and not any(re.search(r"keys=\[[^\]]*event_id", line) for line in sketched) and " percentile(" not in plan


def test_kinds_cost_no_calls_for_each_key(spark):
    """All keys of a bucket are one state, large and null ones among them; an earlier batch's counts go on."""
    large = 2**53 + 1
    rows = [(k, ["a", None, "c"][k % 3], large + k % 50 if k % 7 else None, k % 3) for k in range(600)]
    df = spark.createDataFrame(rows, "id bigint, kind string, who bigint, batch bigint")
    with S.rocksdb(spark):
        got = S.finished(stateful.running_kinds(arrivals.in_turns(df, F.col("batch"), 3), "who", "kind", buckets=3), "append").collect()
    want = Counter((who, kind or "") for _, kind, who, _ in rows)
    last = {}
    for r in got:
        last[r.who, r.kind] = max(last.get((r.who, r.kind), (0, 0)), (r.n, r.known))
    assert {p: n for p, (n, _) in last.items()} == want
    calls = []

    class State:
        def get(self):
            calls.append("get")

        def update(self, value):
            calls.append(value)

    one = stateful._Kinds(None)
    one.state = State()
    list(one.handleInputRows((0,), iter([pd.DataFrame({"key": [str(k) for k in range(500)], "kind": ["a"] * 500})]), None))
    assert len(calls) == 2 and len(calls[1][0]) == 500


def test_lines_are_counted_before_they_are_joined(spark, tmp_path):
    lines = [(k % 5 if k % 11 else None, ["A", "R", None][k % 3]) for k in range(400)] + [(1, "A")] * 600 + [(77, "A")]
    d = folder(spark, tmp_path, lineitem=spark.createDataFrame(lines, "l_partkey bigint, l_returnflag string"), part=spark.createDataFrame([(0, "x"), (1, "x"), (2, None), (3, "y"), (3, "z"), (None, "w"), (4, "y")], "p_partkey bigint, p_brand string"))
    assert same(spark, d, "join_salted", "lineitem", "part") == []
    plan = catalog.QUERIES["join_salted"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner") :]  # under the join
    assert "Aggregate [l_partkey" in below and "strategy=merge" in plan


def test_timed_blocks_read_texts_once(spark, data, monkeypatch):
    seen, delayed = [], arrivals.delayed
    monkeypatch.setattr(arrivals, "delayed", lambda df, *a: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), delayed(df, *a))[1])
    got = catalog.QUERIES["pack_stream_timed"](spark, data)
    assert len(seen) == 1 and "regexp" not in seen[0] and "text#" not in seen[0]
    assert oracle.differences(got, oracle.duck(data), catalog.ORACLE_SQL["pack_stream_timed"]) == []
