"""Structured Streaming over the events table, run to completion, and packing as documents arrive.

Each function returns a batch DataFrame of what the stream gave. Event times
are NTZ in the tables and cast to TIMESTAMP in UTC, since watermarks need it.
What a stream gives and its state go to the folder that driver and executors
share; nothing is gathered in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..sources.scratch import fresh_path

STORE = "spark.sql.streaming.stateStore.providerClass"


def arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, one file or a folder of files, as a stream."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    one_file = [f.rstrip("/").rsplit("/", 1)[-1] for f in table.inputFiles()] == [f"{name}.parquet"]
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one_file else stream.parquet(path)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream."""
    return arriving(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what there is, and returns what it gave: appended to files, or as the last complete result."""
    spark = stream.sparkSession
    path, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    spark.createDataFrame([], stream.schema).write.parquet(path)  # a stream that gives nothing is an empty table
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        q = out.format("parquet").option("path", path).start()
    else:
        q = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _edges(df: DataFrame, *columns: str) -> DataFrame:
    cast = lambda c: F.col(f"window.{c}").cast("timestamp_ntz").alias(f"window_{c}")
    return df.select(cast("start"), cast("end"), *columns)


def tumbling(stream: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding(stream: DataFrame, length: str = "2 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide)).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n"))


def first_of_keys(stream: DataFrame, late: str = "60 days") -> DataFrame:
    """The first event of each user and type within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def interval_join(stream: DataFrame, again: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Views with a purchase of the same user soon after."""
    a = stream.filter("event_type = 'view'").select("event_id", F.col("user_id").alias("u"), F.col("ts").alias("t")).withWatermark("t", late)
    b = again.filter("event_type = 'purchase'").select(F.col("event_id").alias("later"), "user_id", "ts").withWatermark("ts", late)
    return a.join(b, F.expr(f"u = user_id AND ts > t AND ts <= t + INTERVAL {within}")).select("event_id", "later")


def pack_stream(stream: DataFrame, length: int, key: str = "source", rest: bool = False) -> DataFrame:
    """(key, chunk, ntok) of blocks as documents (key, n) arrive; the tokens left over wait in the state.

    Append output; a block comes out when it is full, so the last, open one of a
    key doesn't. With rest, the open block of a key comes out as well, as large as
    it is, whenever documents of the key arrive: flushed() has the end state.
    """
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, chunk = state.get if state.exists else (0, 0)
        left += sum(int(p["n"].sum()) for p in parts)
        full = left // length
        left %= length
        state.update((left, chunk + full))
        sizes = [length] * full + [left] * (rest and left > 0)
        yield pd.DataFrame({key: [k[0]] * len(sizes), "chunk": range(chunk, chunk + len(sizes)), "ntok": sizes})

    return stream.select(key, "n").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, chunk bigint, ntok bigint", "left bigint, chunk bigint", "append", GroupStateTimeout.NoTimeout)


def flushed(blocks: DataFrame, key: str = "source") -> DataFrame:
    """(key, chunk, ntok) of what pack_stream gave with rest: each block as it was last, since it only grows."""
    return blocks.groupBy(key, "chunk").agg(F.max("ntok").alias("ntok"))


class _Totals(StatefulProcessor):
    """Events and their summed value of each key so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n bigint, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, value = self.total.get() if self.total.exists() else (0, 0.0)
        for p in rows:
            n, value = n + len(p), value + float(p["value"].sum())
        self.total.update((n, value))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [value]})

    def close(self) -> None:
        pass


def running_totals(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, n, total): after each micro-batch the totals of the keys it touched; needs the RocksDB state store."""
    kind = dict(stream.dtypes)[key]
    rows = stream.select(F.col(key).alias("key"), "value").groupBy("key")
    return rows.transformWithStateInPandas(_Totals(), f"key {kind}, n bigint, total double", "append", "None").withColumnRenamed("key", key)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within this keep their state in RocksDB."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
