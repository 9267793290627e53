"""Reading and writing tables: Parquet, JSON, CSV, ORC and text, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, <name>.parquet."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A table in any of Spark's formats. Text formats need a schema; nothing is inferred from data."""
    if fmt in ("json", "csv") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(fmt).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = (), mode: str = "errorifexists", **options: str) -> None:
    """Writes df, one folder for each value of the columns `by`."""
    df.write.options(**options).mode(mode).partitionBy(*by).format(fmt).save(path)
