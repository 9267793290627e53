"""Streams whose events come out of order, over several micro-batches, and streams that give nothing."""

import datetime
import os

from pyspark.sql import functions as F

from millrace.streaming import windows as S

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1, hour, minute)


def arriving_in_turns(spark, folder, batches):
    """A stream with a micro-batch for each list of rows, in order."""
    for k, rows in enumerate(batches):
        path = f"{folder}/{k}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
        name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{path}/{name}", f"{folder}/in/{k}.parquet")
        os.utime(f"{folder}/in/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_late_events_are_dropped_past_the_watermark(spark, tmp_path):
    batches = [
        [(1, at(10, 5), 1, "view", 1.0), (2, at(9, 50), 1, "view", 1.0)],
        [(3, at(14), 1, "view", 1.0)],
        [(5, at(13, 30), 2, "view", 1.0)],  # late, but not past 13:00
        [(4, at(10, 10), 1, "view", 1.0)],  # past it; a batch's late rows are told by the watermark of the batch before
        [(6, at(20), 1, "view", 1.0)],
    ]
    stream = arriving_in_turns(spark, str(tmp_path), batches)
    got = S.finished(S.tumbling(stream, "1 hour", "1 hour"), "append").select(F.hour("window.start").alias("h"), "n").collect()
    assert {r.h: r.n for r in got} == {9: 1, 10: 1, 13: 1, 14: 1}  # the window of 20:00 is still open


def test_events_out_of_order_within_the_watermark_count(spark, tmp_path):
    batches = [[(1, at(10, 40), 1, "view", 1.0)], [(2, at(10, 5), 1, "view", 1.0), (3, at(10, 20), 1, "view", 1.0)], [(4, at(9, 50), 1, "view", 1.0)]]
    stream = arriving_in_turns(spark, str(tmp_path), batches)
    got = S.finished(S.sessions(stream, "30 minutes", "1 hour"), "complete").collect()
    assert [r.n for r in got] == [4]


def test_repeats_within_the_watermark_go_once(spark, tmp_path):
    batches = [[(1, at(10), 1, "view", 1.0)], [(2, at(9, 30), 1, "view", 1.0), (3, at(10, 1), 2, "view", 1.0)]]
    got = S.finished(S.first_of_keys(arriving_in_turns(spark, str(tmp_path), batches), "2 hours"), "append").collect()
    assert sorted(map(tuple, got)) == [(1, "view"), (2, "view")]


def test_a_stream_that_gives_nothing_is_an_empty_table(spark, tmp_path):
    stream = arriving_in_turns(spark, str(tmp_path), [[(1, at(10), 1, "view", 1.0)]])
    assert S.finished(stream.filter("event_id > 5"), "append").columns == stream.columns
    assert S.finished(S.interval_join(stream, stream), "append").count() == 0
