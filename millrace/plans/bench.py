"""Measuring queries: timed runs kept as a table, and what follows from such tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: cores: tasks that the run's input was dealt to, all cores if 0; bytes: of the files of the tables read.
RUNS = "query string, sf double, cores int, run int, seconds double, rows bigint, bytes bigint, tokens bigint"


def run_once(spark: SparkSession, query: Callable[[SparkSession, str], DataFrame], sf_dir: str) -> float:
    """Wall seconds of one run to a sink that keeps nothing."""
    began = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
    return time.perf_counter() - began


def read_by(spark: SparkSession, sf_dir: str, tables: Sequence[str]) -> tuple[int, int]:
    """(rows, bytes) of the tables: rows by counting, bytes from the listing of their files."""
    rows = sum(table(spark, sf_dir, t).count() for t in tables)
    size = sum(spark.read.format("binaryFile").load(f"{sf_dir.rstrip('/')}/{t}.parquet").agg(F.sum("length")).first()[0] for t in tables)
    return rows, size


def run_bench(spark: SparkSession, queries: dict[str, Callable], sf_dir: str, sf: float, repeats: int = 3, reads: dict[str, Sequence[str]] | None = None, tokens: int = 0, cores: int | None = None) -> DataFrame:
    """RUNS rows of `repeats` runs of each query after one to warm up. reads: the tables that a query reads, for its rows and bytes."""
    out = []
    for name, query in queries.items():
        rows, size = read_by(spark, sf_dir, (reads or {}).get(name, ()))
        run_once(spark, query, sf_dir)
        out += [(name, sf, spark.sparkContext.defaultParallelism if cores is None else cores, k, run_once(spark, query, sf_dir), rows, size, tokens) for k in range(repeats)]
    return spark.createDataFrame(out, RUNS)


def keep_runs(runs: DataFrame, path: str) -> DataFrame:
    """Appends runs to a stored table of them, and returns all that it holds."""
    runs.write.mode("append").parquet(path)
    return runs.sparkSession.read.schema(RUNS).parquet(path)


def scan_runs(spark: SparkSession, sf_dir: str, sf: float, tables: Sequence[str], cores: Sequence[int], path: str, repeats: int = 3) -> DataFrame:
    """Timed scans and aggregates of whole tables, each dealt to as many tasks as `cores` says, appended to the stored runs."""
    for c in cores:
        queries = {t: lambda s, d, t=t, c=c: _digest(table(s, d, t).coalesce(c)) for t in tables}
        out = keep_runs(run_bench(spark, queries, sf_dir, sf, repeats, {t: (t,) for t in tables}, cores=c), path)
    return out


def _digest(df: DataFrame) -> DataFrame:
    """A hash of all columns of all rows."""
    return df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("digest"), F.count("*").alias("n"))


def bench_summary(runs: DataFrame) -> DataFrame:
    """(query, sf, cores, median_s, min_s, max_s, rows_s, bytes_s, tok_s)."""
    by = runs.groupBy("query", "sf", "cores").agg(F.percentile("seconds", F.lit(0.5)).alias("median_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"), *[F.max(c).alias(c) for c in ("rows", "bytes", "tokens")])
    speed = lambda c, name: F.round(F.col(c) / F.col("median_s"), 3).alias(name)
    return by.select("query", "sf", "cores", "median_s", "min_s", "max_s", speed("rows", "rows_s"), speed("bytes", "bytes_s"), speed("tokens", "tok_s"))


def scaling(summary: DataFrame) -> DataFrame:
    """(query, sf, cores, speedup, efficiency) against the same query's run on the fewest cores."""
    base = summary.groupBy("query", "sf").agg(F.min("cores").alias("c0"), F.min_by("median_s", "cores").alias("s0"))
    speedup = F.col("s0") / F.col("median_s")
    return summary.join(base, ["query", "sf"]).select("query", "sf", "cores", F.round(speedup, 6).alias("speedup"), F.round(speedup * F.col("c0") / F.col("cores"), 6).alias("efficiency"))


def bench_regression(summary: DataFrame, base: DataFrame, threshold: float = 1.2) -> DataFrame:
    """(query, sf, cores, ratio, slower): times against an earlier summary's."""
    old = base.select("query", "sf", "cores", F.col("median_s").alias("old"))
    ratio = F.round(F.col("median_s") / F.col("old"), 6)
    return summary.join(old, ["query", "sf", "cores"]).select("query", "sf", "cores", ratio.alias("ratio"), (ratio > threshold).alias("slower"))
