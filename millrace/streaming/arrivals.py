"""A table as a stream of many micro-batches: rows in the order in which they arrive, some late.

Batches are written one after the other, as files of equal number, and read back
oldest first by so many files at once: Spark's file source goes by the time a file
was written. Streams over them keep state from batch to batch, move their
watermark and let state go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.relational import places
from ..sources.scratch import fresh_path, remove, written

#: Rows of a file, about.
FILE_ROWS = 2_000_000


def in_turns(df: DataFrame, batch: Column, batches: int) -> DataFrame:
    """df as a stream with a micro-batch for each number from 0 to batches - 1 that `batch` has; the column itself goes."""
    spark: SparkSession = df.sparkSession
    numbered = written(df.withColumn("__batch", batch), "numbered")
    files = numbered.groupBy("__batch").count().agg(F.max("count")).first()[0] or 0
    files, path = -(-files // FILE_ROWS) or 1, fresh_path(spark, "arrivals")
    for k in range(batches):
        own = numbered.filter(F.col("__batch") == k).drop("__batch")
        own.repartition(files).write.mode("append").parquet(path)
    remove(numbered)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def delayed(df: DataFrame, at: str, key: str, batches: int, delays: dict[int, int]) -> DataFrame:
    """df with batch: its place in time order cut into equal batches, and of each hundred hashes of the key so many arrive `delay` batches later.

    delays: delay -> hundredths; the rest arrives in time, nothing after the last batch.
    """
    n = df.count()
    slot = F.floor((F.col("__place") - 1) * batches / F.lit(max(n, 1)))
    late, low, share = F.lit(0), 0, T.hash_bucket(key)
    for delay, hundredths in delays.items():
        late = F.when((share >= low) & (share < low + hundredths), delay).otherwise(late)
        low += hundredths
    return places(df, [F.col(at), F.col(key)], "__place").withColumn("batch", F.least(slot + late, F.lit(batches - 1)).cast("long")).drop("__place")
