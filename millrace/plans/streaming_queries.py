"""Streaming queries, each run to completion, and the SQL of the same over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing
from ..sources.scratch import remove, written
from ..sources.tables import table
from ..streaming import arrivals, stateful
from ..streaming import windows as S
from .registry import registry

QUERIES, SQL, query = registry()


@query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return S._edges(S.finished(S.tumbling(S.events(spark, d)), "complete"), "event_type", "n", "total")


@query("""SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2""")
def stream_sliding(spark, d):
    return S._edges(S.finished(S.sliding(S.events(spark, d)), "complete"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
     s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    return S._edges(S.finished(S.sessions(S.events(spark, d)), "complete"), "user_id", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return S.finished(S.first_of_keys(S.events(spark, d)), "append")


@query("SELECT a.event_id, b.event_id AS later FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def stream_interval_join(spark, d):
    return S.finished(S.interval_join(S.events(spark, d), S.events(spark, d)), "append")


@query(r"""WITH t AS (SELECT source, CAST(sum(len(regexp_extract_all(text, '\S+')) + 1) AS BIGINT) AS n FROM documents GROUP BY source),
     x AS (SELECT source, n, unnest(range((n + 511) // 512)) AS chunk FROM t)
SELECT source, chunk, least(512, n - chunk * 512) AS ntok FROM x""")
def pack_stream(spark, d):
    docs = packing.lengths(S.arriving(spark, d, "documents"))
    return S.flushed(S.finished(S.pack_stream(docs, 512, rest=True), "append"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_totals(spark, d):
    """The last totals of each user."""
    with S.rocksdb(spark):
        seen = S.finished(S.running_totals(S.events(spark, d)), "append")
    return seen.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


#: Batches of the streams below, and of each hundred events those that arrive so many batches late.
BATCHES, DELAYS = 8, {1: 15, 3: 10}
HASH = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100"
ARRIVED = f"""o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS place, count(*) OVER () AS n, {HASH} AS h FROM events),
     a AS (SELECT *, least(CAST(floor(place * {BATCHES} / n) AS BIGINT) + CASE WHEN h < 15 THEN 1 WHEN h < 25 THEN 3 ELSE 0 END, {BATCHES - 1}) AS batch FROM o)"""


def _arriving(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = arrivals.delayed(e, "ts", "event_id", BATCHES, DELAYS)
    return arrivals.in_turns(late, F.col("batch"), BATCHES)


@query(f"""WITH {ARRIVED},
     marks AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch) - INTERVAL 4 DAY AS mark FROM a GROUP BY batch),
     kept AS (SELECT date_trunc('day', ts) AS w, event_type, value FROM a LEFT JOIN marks ON marks.batch = a.batch - 2 WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark)
SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM kept WHERE w + INTERVAL 1 DAY <= (SELECT max(mark) FROM marks) GROUP BY w, event_type""")
def stream_late(spark, d):
    """Daily windows in append mode over eight batches, a tenth of the events too late: each window comes out once, when the watermark has passed it.

    A batch drops rows of windows that the watermark of two batches before has
    passed: that was the one which the batch before let state go by.
    """
    return S._edges(S.finished(S.tumbling(_arriving(spark, d), "1 day", "4 days"), "append"), "event_type", "n", "total")


BLOCK = 512


@query(rf"""WITH t AS (SELECT source, doc_id, CAST(len(regexp_extract_all(text, '\S+')) + 1 AS BIGINT) AS n FROM documents),
     s AS (SELECT source, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS b FROM t),
     x AS (SELECT source, n, b, unnest(range(CAST(b // {BLOCK} AS BIGINT), CAST((b + n - 1) // {BLOCK} + 1 AS BIGINT))) AS chunk FROM s)
SELECT source, chunk, count(*) AS segs, CAST(sum(least(b + n, (chunk + 1) * {BLOCK}) - greatest(b, chunk * {BLOCK})) AS BIGINT) AS ntok, sum(least(b + n, (chunk + 1) * {BLOCK}) - greatest(b, chunk * {BLOCK})) < {BLOCK} AS timed FROM x GROUP BY source, chunk""")
def pack_stream_timed(spark, d):
    """Documents arrive in five batches, a second apart; a row without words after the last moves the clock on, so that timers close what is open."""
    docs = packing.lengths(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", F.col("n").cast("long").alias("n"), F.timestamp_seconds(F.col("doc_id") + 1).alias("at"))
    counted = written(docs, "lengths")  # texts are read once
    docs = arrivals.delayed(counted, "at", "doc_id", 5, {})
    end = docs.agg(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n"), (F.max("at") + F.expr("INTERVAL 2 HOURS")).alias("at"), F.lit(5).cast("long").alias("batch"))
    stream = arrivals.in_turns(docs.unionByName(end), F.col("batch"), 6)
    remove(counted)
    with S.rocksdb(spark):
        return S.finished(stateful.timed_blocks(stream, BLOCK), "append").select("source", "chunk", "segs", "ntok", "timed")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def stream_kinds(spark, d):
    """A map of each user's kinds of events, kept over eight batches."""
    with S.rocksdb(spark):
        seen = S.finished(stateful.running_kinds(_arriving(spark, d)), "append")
    return seen.groupBy("user_id", "event_type").agg(F.max("n").alias("n"))
