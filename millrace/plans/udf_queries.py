"""Each way to run Python on rows, on work that SQL can check. Built-in functions are the way where they can express it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..sources.tables import table
from .registry import registry

QUERIES, SQL, query = registry()


@query("SELECT p_partkey, reverse(p_name) AS back FROM part")
def udf_row(spark, d):
    back = F.udf(lambda s: s and s[::-1], "string")
    return table(spark, d, "part").select("p_partkey", back("p_name").alias("back"))


@query("SELECT c_custkey, c_acctbal * 2 + 1 AS x FROM customer")
def udf_pandas(spark, d):
    @F.pandas_udf("double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return table(spark, d, "customer").select("c_custkey", twice("c_acctbal").alias("x"))


@query("SELECT c_custkey, upper(c_mktsegment) AS x FROM customer")
def udf_arrow(spark, d):
    @F.arrow_udf("string")
    def upper(x: pa.Array) -> pa.Array:
        return pc.utf8_upper(x)

    return table(spark, d, "customer").select("c_custkey", upper("c_mktsegment").alias("x"))


@query("SELECT event_type, round(max(value) - min(value), 4) AS spread FROM events GROUP BY event_type")
def udf_aggregate(spark, d):
    """The ends of each type by user first, so that no worker gathers a type's rows; the types' ends are then few."""

    @F.pandas_udf("double")
    def least(x: pd.Series) -> float:
        return float(x.min())

    @F.pandas_udf("double")
    def most(x: pd.Series) -> float:
        return float(x.max())

    users = table(spark, d, "events").groupBy("event_type", "user_id").agg(least("value").alias("low"), most("value").alias("high"))
    return users.groupBy("event_type").agg(F.round(F.max("high") - F.min("low"), 4).alias("spread"))


@query("SELECT n_nationkey, CAST(unnest(range(1, length(n_name) + 1)) AS INTEGER) AS at, unnest(string_split(n_name, '')) AS letter FROM nation")
def udtf_rows(spark, d):
    @F.udtf(returnType="at: int, letter: string")
    class Letters:
        def eval(self, row: Row):
            for at, letter in enumerate(row, 1):
                yield at, letter

    spark.udtf.register("letters", Letters)
    table(spark, d, "nation").createOrReplaceTempView("v_nation")
    return spark.sql("SELECT n_nationkey, at, letter FROM v_nation, LATERAL letters(n_name)")


@query("SELECT event_id, value * value AS square FROM events")
def udtf_arrow(spark, d):
    """A table argument in Arrow batches."""

    @F.arrow_udtf(returnType="event_id bigint, square double")
    class Squares:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            yield pa.table({"event_id": rows.column("event_id"), "square": pc.multiply(rows.column("value"), rows.column("value"))})

    spark.udtf.register("squares", Squares)
    table(spark, d, "events").select("event_id", "value").createOrReplaceTempView("v_values")
    return spark.sql("SELECT * FROM squares(TABLE(v_values))")


@query("""SELECT user_id, event_id, row_number() OVER w AS nth, event_type <> lag(event_type, 1, '') OVER w AS changed, round(value - coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), value), 6) AS above
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def udtf_table(spark, d):
    """A table argument, dealt by user and in order: each event against what the user did before. A user's rows pass by one at a time."""

    @F.udtf
    class Along:
        def __init__(self):
            self.nth, self.last, self.most = 0, "", None

        @staticmethod
        def analyze(events: AnalyzeArgument) -> AnalyzeResult:
            kinds = {f.name: f.dataType for f in events.dataType.fields}
            schema = StructType().add("user_id", kinds["user_id"]).add("event_id", kinds["event_id"]).add("nth", LongType()).add("changed", BooleanType()).add("above", DoubleType())
            return AnalyzeResult(schema)

        def eval(self, row: Row):
            self.nth += 1
            above = row["value"] - (row["value"] if self.most is None else self.most)
            yield row["user_id"], row["event_id"], self.nth, row["event_type"] != self.last, round(above, 6)
            self.last, self.most = row["event_type"], row["value"] if self.most is None else max(self.most, row["value"])

    spark.udtf.register("along", Along)
    table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value").createOrReplaceTempView("v_events")
    return spark.sql("SELECT * FROM along(TABLE(v_events) PARTITION BY user_id ORDER BY (ts, event_id))")


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS x FROM lineitem WHERE l_quantity > 25")
def map_pandas(spark, d):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[p["l_quantity"] > 25].assign(x=lambda p: p["l_quantity"] * p["l_extendedprice"])[["l_orderkey", "l_linenumber", "x"]]

    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return lines.mapInPandas(run, "l_orderkey bigint, l_linenumber int, x double")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.04")
def map_arrow(spark, d):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.greater(b.column("l_tax"), 0.04)).select(["l_orderkey", "l_linenumber"])

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax").mapInArrow(run, "l_orderkey bigint, l_linenumber int")


@query("SELECT event_type, event_id, value - avg(value) OVER (PARTITION BY event_type, user_id) > 0 AS above FROM events")
def apply_pandas(spark, d):
    """Groups of one type and user, each as large as one user's events. The mean is of the sum rounded once, so it doesn't go by the order in which rows arrive."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        value, missing = p["value"].to_numpy(), p["missing"].to_numpy()
        known = value[~missing]
        total = math.fsum(known) if np.isfinite(known).all() else known.sum()
        over = value - total / max(len(known), 1)
        above = (over > 0) | np.isnan(over)  # not a number is above any, as in the SQL
        return pd.DataFrame({"event_type": p["event_type"], "event_id": p["event_id"], "above": pd.arrays.BooleanArray(above, missing)})

    e = table(spark, d, "events").select("event_type", "event_id", "user_id", F.coalesce("value", F.lit(0.0)).alias("value"), F.isnull("value").alias("missing"))
    return e.groupBy("event_type", "user_id").applyInPandas(run, "event_type string, event_id bigint, above boolean")


@query("SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY o_custkey")
def apply_arrow(spark, d):
    def run(t: pa.Table) -> pa.Table:
        return pa.table({"o_custkey": t["o_custkey"].slice(0, 1), "n": [t.num_rows], "last": [pc.max(t["o_orderkey"]).as_py()]})

    return table(spark, d, "orders").select("o_custkey", "o_orderkey").groupBy("o_custkey").applyInArrow(run, "o_custkey bigint, n bigint, last bigint")


@query("""SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation
WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def cogroup_pandas(spark, d):
    """Two tables by one key, whose counts are summed before they meet."""
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "customers": [int(x["n"].sum())], "suppliers": [int(y["n"].sum())]})

    return a.groupBy("k").cogroup(b.groupBy("k")).applyInPandas(run, "k int, customers bigint, suppliers bigint")
