"""Sources, sinks and measures: tables written and read again in each format, and figures of stored runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import segments, tables
from ..sources.scratch import fresh_path
from ..sources.segments import Segments
from ..sources.tables import table
from ..streaming.windows import finished
from . import bench
from .registry import registry

QUERIES, SQL, query = registry()


def _round_trip(spark, df, fmt, by=(), schema=None):
    path = fresh_path(spark, f"round-trip-{fmt}")
    tables.write(df, path, fmt, by)
    return tables.read(spark, path, fmt, schema)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def source_parquet_partitioned(spark, d):
    """One folder for each status, read back with the status from the folders' names."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return _round_trip(spark, o, "parquet", ("o_orderstatus",))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def source_orc(spark, d):
    return _round_trip(spark, table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), "orc")


@query("SELECT conv_id, turn, role, text FROM conversations")
def source_json(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return _round_trip(spark, c, "json", schema=c.schema)


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def source_csv(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return _round_trip(spark, p, "csv", schema=p.schema)


@query("SELECT n_name AS value FROM nation")
def source_text(spark, d):
    return _round_trip(spark, table(spark, d, "nation").select(F.col("n_name").alias("value")), "text")


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE role = 'assistant' AND turn >= 2")
def source_custom(spark, d):
    """Conversations through a source of our own: written with a commit, read with filters pushed into it."""
    spark.dataSource.register(Segments)
    spark.conf.set(segments.PUSHDOWN, "true")
    turns, path = _turns(spark, d), fresh_path(spark, "segments")
    turns.write.format("segments").mode("append").save(path)
    return spark.read.format("segments").schema(turns.schema).load(path).filter("role = 'assistant' AND turn >= 2")


@query("SELECT conv_id, turn, role, text FROM conversations")
def source_custom_stream(spark, d):
    """Three commits of turns, read back as a stream by the offsets of the log."""
    spark.dataSource.register(Segments)
    turns, path = _turns(spark, d), fresh_path(spark, "segments")
    for k in range(3):
        turns.filter(F.pmod("conv_id", F.lit(3)) == k).write.format("segments").mode("append").save(path)
    return finished(spark.readStream.format("segments").schema(turns.schema).load(path), "append")


#: The tables whose scans are timed, the tasks they are dealt to, and runs of each.
TIMED, CORES, REPEATS = ("part", "customer", "orders"), (1, 2, 4), 2
TIMED_SQL = " UNION ALL ".join(f"SELECT '{t}' AS query, count(*) AS rows FROM {t}" for t in TIMED)


def _runs(spark, d):
    return bench.scan_runs(spark, d, 0.0, TIMED, CORES, fresh_path(spark, "runs"), REPEATS)


def _same(spark, runs, figures, sql, key=("query", "cores")):
    """(query, cores, rows, runs, same): whether figures equal what SQL says over the stored runs."""
    runs.createOrReplaceTempView("stored_runs")
    names = [c for c in figures.columns if c not in key]
    theirs = spark.sql(sql).select(*key, F.struct(*names).alias("theirs"))
    both = figures.select(*key, F.struct(*names).alias("mine")).join(theirs, list(key), "full")
    n = runs.groupBy(*key).agg(F.max("rows").alias("rows"), F.count("*").alias("runs"))
    return n.join(both, list(key), "left").select(*key, "rows", "runs", F.coalesce(F.col("mine") == F.col("theirs"), F.lit(False)).alias("same"))


EACH = f"SELECT query, CAST(unnest({list(CORES)}) AS INTEGER) AS cores, rows, CAST({REPEATS} AS BIGINT) AS runs, true AS same FROM ({TIMED_SQL})"
SUMMARY = "SELECT query, sf, cores, median(seconds) AS median_s, min(seconds) AS min_s, max(seconds) AS max_s, round(max(rows) / median(seconds), 3) AS rows_s, round(max(bytes) / median(seconds), 3) AS bytes_s, round(max(tokens) / median(seconds), 3) AS tok_s FROM stored_runs GROUP BY query, sf, cores"


@query(EACH)
def bench_summary(spark, d):
    """Measured scans of three tables, stored: the summary's figures against SQL over the stored runs."""
    runs = _runs(spark, d)
    return _same(spark, runs, bench.bench_summary(runs), SUMMARY)


@query(EACH)
def bench_scaling(spark, d):
    runs = _runs(spark, d)
    sql = f"WITH s AS ({SUMMARY}), b AS (SELECT query, sf, min(cores) AS c0, min_by(median_s, cores) AS s0 FROM s GROUP BY query, sf) SELECT query, sf, cores, round(s0 / median_s, 6) AS speedup, round(s0 / median_s * c0 / cores, 6) AS efficiency FROM s JOIN b USING (query, sf)"
    return _same(spark, runs, bench.scaling(bench.bench_summary(runs)), sql)


@query(EACH)
def bench_regression(spark, d):
    """The last run of each measured query against its first."""
    runs = _runs(spark, d)
    first, last = (bench.bench_summary(runs.filter(c)) for c in ("run = 0", f"run = {REPEATS - 1}"))
    sql = f"SELECT a.query, a.sf, a.cores, round(b.seconds / a.seconds, 6) AS ratio, round(b.seconds / a.seconds, 6) > 1.2 AS slower FROM stored_runs a JOIN stored_runs b USING (query, cores) WHERE a.run = 0 AND b.run = {REPEATS - 1}"
    return _same(spark, runs, bench.bench_regression(last, first), sql)


@query("SELECT 'parts' AS query, CAST(2 AS BIGINT) AS runs, true AS timed, max(count) AS rows FROM (SELECT count(*) AS count FROM part)")
def bench_run(spark, d):
    """Two timed runs of a query after one to warm up: whether each has a time."""
    runs = bench.run_bench(spark, {"parts": lambda s, folder: table(s, folder, "part")}, d, 0.0, 2, {"parts": ("part",)})
    return runs.groupBy("query").agg(F.count("*").alias("runs"), F.bool_and(F.col("seconds") > 0).alias("timed"), F.max("rows").alias("rows"))
