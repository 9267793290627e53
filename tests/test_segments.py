"""The custom source: commits, filters that reach it, writes that fail, offsets of its stream."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import segments
from millrace.streaming.windows import finished

SCHEMA = "id bigint, name string, x double, flag boolean"


@pytest.fixture
def place(spark, tmp_path):
    spark.dataSource.register(segments.Segments)
    spark.conf.set(segments.PUSHDOWN, "true")
    return f"file://{tmp_path}/table"


def frame(spark, low, high, parts=4):
    return spark.range(low, high, 1, parts).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("n"), F.col("id") % 10)).alias("name"), (F.col("id") / 2).alias("x"), (F.col("id") % 2 == 0).alias("flag"))


def read(spark, place):
    return spark.read.format("segments").schema(SCHEMA).load(place)


def save(df, place, mode="append"):
    df.write.format("segments").mode(mode).save(place)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_filters_reach_the_source_and_drop_files(spark, place):
    save(frame(spark, 0, 400), place)
    df = frame(spark, 0, 400)
    for condition in ("id = 17", "id IN (3, 399)", "id > 390", "id >= 390 AND name IS NOT NULL", "id < 5", "id <= 5", "name = 'n3'", "id = 17 AND flag", "id + 1 = 4", "name LIKE 'n1%'", "x > 150.5", "name IS NULL", "id = 1 OR id = 2"):
        assert rows(read(spark, place).filter(condition)) == rows(df.filter(condition)), condition
    planned = lambda condition: read(spark, place).filter(condition)._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in planned("id = 17") and "Filter (" not in planned("name IN ('n1', 'n2') AND id > 3")  # the source takes them
    assert "Filter (" in planned("id + 1 = 4")
    assert read(spark, place).filter("id = 17").rdd.getNumPartitions() == 1 and read(spark, place).rdd.getNumPartitions() == 4


def test_a_write_that_fails_leaves_nothing(spark, place, tmp_path):
    save(frame(spark, 0, 20), place)
    broken = frame(spark, 0, 40).withColumn("x", F.when(F.col("id") == 39, F.raise_error(F.lit("no"))).otherwise(F.col("x")))
    with pytest.raises(Exception):  # noqa: B017
        save(broken, place)
    assert rows(read(spark, place)) == rows(frame(spark, 0, 20))
    writer = segments._Writer(place, False)
    name = glob.glob(f"{tmp_path}/table/part-*")[0].rsplit("/", 1)[1]
    (tmp_path / "table" / "part-x.arrow").write_bytes(b"x")
    writer.abort([segments.Written([{"file": "part-x.arrow"}]), None])
    assert not (tmp_path / "table" / "part-x.arrow").exists() and (tmp_path / "table" / name).exists()


def test_append_overwrite_and_empty(spark, place, tmp_path):
    save(frame(spark, 0, 10), place)
    save(frame(spark, 10, 15), place)
    assert rows(read(spark, place)) == rows(frame(spark, 0, 15))
    log = sorted(glob.glob(f"{tmp_path}/table/{segments.LOG}/*"))
    assert len(log) == 2 and sum(f["rows"] for f in json.load(open(log[1]))) == 5
    save(frame(spark, 0, 0), place, "overwrite")
    assert read(spark, place).count() == 0 and not glob.glob(f"{tmp_path}/table/part-*")


def test_stream_goes_by_the_log(spark, place):
    save(frame(spark, 0, 10), place)
    save(frame(spark, 10, 30), place)
    stream = spark.readStream.format("segments").schema(SCHEMA).load(place)
    assert rows(finished(stream, "append")) == rows(frame(spark, 0, 30))
    reader = segments._StreamReader(place, stream.schema)
    assert reader.initialOffset() == {"entries": 0} and reader.latestOffset() == {"entries": 2}
    assert len(reader.partitions({"entries": 1}, {"entries": 2})) == 4
