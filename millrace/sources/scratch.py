"""Intermediate tables in the folder that driver and executors share: written, removed, cleaned up."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete a query's shuffle files when it has ended, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths of the tables that each application has in the shared folder.
_made: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster has to name it; where all run on one machine /tmp/checkpoints stands in."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        conf = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that end within this leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it outlives executors and has no lineage."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes what stands under a path from fresh_path()."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # Spark itself can't delete a path
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.get(spark.sparkContext.applicationId, set()).discard(path)


def remove(*tables: DataFrame) -> None:
    """Deletes tables from written() that nothing reads any more."""
    for df in tables:
        remove_path(df.sparkSession, df.written_to)


def written_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives as a written table; whatever its making has left in the shared folder is removed."""
    made = _made.setdefault(spark.sparkContext.applicationId, set())
    before = set(made)
    out = written(make(), name)
    for path in made - before - {out.written_to}:
        remove_path(spark, path)
    return out


def clean_up(spark: SparkSession) -> None:
    """Deletes every table that operators of this application still have in the shared folder.

    Results read such tables: call it once they are written or no longer wanted.
    """
    for path in list(_made.get(spark.sparkContext.applicationId, ())):
        remove_path(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if it is read from fewer files than the cluster has cores; whatever isn't read from files stays."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
