"""Streams over many micro-batches: timers that close blocks, lanes of a hot key, maps that forget, rows that come too late."""

import datetime
import time

from pyspark.sql import functions as F

from millrace.sources.scratch import fresh_path
from millrace.streaming import arrivals, stateful
from millrace.streaming import windows as S

DOCS = "doc_id bigint, source string, n bigint, s bigint, batch int"


def stream(spark, rows, batches):
    df = spark.createDataFrame(rows, DOCS).withColumn("at", F.timestamp_seconds(F.col("s") + 100))
    return arrivals.in_turns(df.drop("s"), F.col("batch"), batches)


def test_open_blocks_close_once_by_timer(spark):
    rows = [
        (1, "a", 5, 0, 0), (2, "b", 3, 1, 0),
        (3, "a", 4, 20, 1),  # within 60 s: the block of a goes on and gets full
        (4, "b", 8, 500, 2),  # b's first block is 60 s past by then
        (5, "b", 1, 510, 3), (6, None, 2, 505, 3),
        (None, None, None, 9999, 4),
    ]
    with S.rocksdb(spark):
        got = S.finished(stateful.timed_blocks(stream(spark, rows, 5), 8, wait=60), "append").collect()
    blocks = sorted((r.source or "-", r.chunk, r.segs, r.ntok, r.timed) for r in got)
    # the clock reaches 600 s only with the last row: until then b's block of 3 is open where document 4 is in the same batch that moves the clock
    assert sum(b[3] for b in blocks) == 23 and len({b[:2] for b in blocks}) == len(blocks)
    assert [b for b in blocks if b[0] == "a"] == [("a", 0, 2, 8, False), ("a", 1, 1, 1, True)]
    assert [b for b in blocks if b[0] == "-"] == [("-", 0, 1, 2, True)]
    assert all(b[3] == 8 for b in blocks if not b[4])


def test_lanes_share_a_hot_key(spark):
    rows = [(k, "hot", 3, k, k // 50) for k in range(200)] + [(None, None, 0, 99999, 4)]
    with S.rocksdb(spark):
        got = S.finished(stateful.timed_blocks(stream(spark, rows, 5), 16, wait=10, lanes=4), "append").collect()
    assert sum(r.ntok for r in got) == 600 and {r.lane for r in got} == {0, 1, 2, 3}
    assert all(r.ntok == 16 for r in got if not r.timed) and len({(r.lane, r.chunk) for r in got}) == len(got)


def test_kinds_are_counted_over_batches(spark):
    rows = [(k, "ab"[k % 2], 1, k, k % 3) for k in range(12)] + [(50, None, 1, 1, 2)]
    with S.rocksdb(spark):
        got = S.finished(stateful.running_kinds(stream(spark, rows, 3).withColumn("one", F.lit(1)), "one", "source"), "append").collect()
    last = {}
    for r in got:
        last[r.source] = max(last.get(r.source, (0, 0)), (r.n, r.known))
    assert last == {"a": (6, 3), "b": (6, 3), "": (1, 3)}


def test_kinds_are_forgotten(spark):
    """A kind that no row has touched for longer than `forget` is counted anew."""
    rows = [(1, "a", 1, 1, 0), (2, "a", 1, 2, 1)]
    source, out = stream(spark, rows, 2).withColumn("one", F.lit(1)), []
    with S.rocksdb(spark):
        def keep(df, _):
            time.sleep(3)  # longer than kinds are remembered
            out.extend(r.n for r in df.collect())

        q = stateful.running_kinds(source, "one", "source", 1).writeStream.outputMode("append").option("checkpointLocation", fresh_path(spark, "kinds")).foreachBatch(keep).start()
        until = time.time() + 90
        while len(out) < 2 and time.time() < until:
            time.sleep(0.5)
        q.stop()
    assert out[:2] == [1, 1]


def test_batches_come_in_order_and_late_rows_go(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(k, day + datetime.timedelta(hours=k), 1.0, "x") for k in range(96)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, value double, event_type string")
    late = arrivals.delayed(df, "ts", "event_id", 4, {2: 30}).cache()
    assert [r.n for r in late.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] != [24] * 4
    assert late.filter("event_id < 24").agg(F.max("batch")).first()[0] == 2
    got = S.finished(S.tumbling(arrivals.in_turns(late, F.col("batch"), 4), "6 hours", "1 hour"), "append").groupBy("window").agg(F.count("*").alias("c"), F.sum("n").alias("n")).collect()
    assert all(r.c == 1 for r in got) and sum(r.n for r in got) < 90  # each window once; those too late are in none
    assert arrivals.delayed(df.limit(0), "ts", "event_id", 4, {}).count() == 0
