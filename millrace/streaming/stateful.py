"""Custom state by key: blocks that close by size or by an event-time timer, and counts of kinds that are forgotten.

All of these need the RocksDB state store (windows.rocksdb). A key's rows of one
micro-batch are gathered, so the size of a batch bounds what a task holds; a key
with a large share of all rows can be dealt to several lanes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


class _Blocks(StatefulProcessor):
    """The open block as a list of its segments; a timer that runs from its last row on."""

    def __init__(self, length: int, wait_ms: int) -> None:
        self.length, self.wait_ms = length, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "ntok bigint")
        self.chunk = handle.getValueState("chunk", "chunk bigint, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        docs = sorted((o, int(n), int(at)) for p in rows for o, n, at in zip(p["order"], p["n"], p["at_ms"], strict=True) if n == n and n > 0)
        if not docs:
            return
        chunk, timer = self.chunk.get() if self.chunk.exists() else (0, 0)
        segments, out = [s[0] for s in self.open.get()] if self.open.exists() else [], []
        used = sum(segments)
        for _, n, _ in docs:
            while n:
                took = min(n, self.length - used)
                segments.append(took)
                used, n = used + took, n - took
                if used == self.length:
                    out.append((chunk, len(segments), used, False))
                    chunk, segments, used = chunk + 1, [], 0
        if timer:
            self.handle.deleteTimer(timer)
        timer = max(at for *_, at in docs) + self.wait_ms if segments else 0
        if segments:
            self.open.put([(s,) for s in segments])
            self.handle.registerTimer(timer)
        else:
            self.open.clear()
        self.chunk.update((chunk, timer))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        chunk, timer = self.chunk.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        segments = [s[0] for s in self.open.get()]
        self.open.clear()
        self.chunk.update((chunk + 1, 0))
        yield self._rows(key, [(chunk, len(segments), sum(segments), True)])

    def _rows(self, key: tuple, blocks: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *b) for b in blocks], columns=["key", "lane", "chunk", "segs", "ntok", "timed"])

    def close(self) -> None:
        pass


def timed_blocks(stream: DataFrame, length: int, key: str = "source", order: str = "doc_id", at: str = "at", wait: int = 3600, late: str = "0 seconds", lanes: int = 1) -> DataFrame:
    """(key, lane, chunk, segs, ntok, timed) of documents (key, order, at, n): every block once.

    A block comes out when it is full, or, as it is, `wait` seconds of event time
    after its last document, when the watermark has passed them; the next document
    of the key then begins a block of its own. A key's documents of a micro-batch
    are taken by order. Times at or before 1970 are late. Rows whose n is null or 0 only move the watermark. Rows
    behind the watermark are dropped, as in every stream. lanes: parts that a
    key's documents are dealt to by a hash of order, each with blocks of its own.
    """
    kind = dict(stream.dtypes)[key]
    lane = F.pmod(F.xxhash64(order), F.lit(lanes)).cast("int")
    rows = stream.withWatermark(at, late).select(F.col(key).alias("key"), lane.alias("lane"), F.col(order).alias("order"), "n", F.unix_millis(at).alias("at_ms"), at).groupBy("key", "lane")
    out = rows.transformWithStateInPandas(_Blocks(length, 1000 * wait), f"key {kind}, lane int, chunk bigint, segs bigint, ntok bigint, timed boolean", "append", "EventTime")
    return out.withColumnRenamed("key", key)


class _Kinds(StatefulProcessor):
    """Rows of each kind so far, of all keys of a bucket: read and kept as a whole once a micro-batch. A kind not seen for a while is forgotten."""

    def __init__(self, forget_ms: int | None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kinds", "keys array<string>, kinds array<string>, counts array<bigint>, seen array<bigint>", self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        more = Counter()
        for p in rows:
            more.update(zip(p["key"], p["kind"], strict=True))
        now = 0 if self.forget_ms is None else timerValues.getCurrentProcessingTimeInMs()
        before = self.state.get()
        counts = {(k, kind): (n, at) for k, kind, n, at in zip(*before, strict=True) if self.forget_ms is None or now < at + self.forget_ms} if before else {}
        for pair, n in more.items():
            counts[pair] = counts.get(pair, (0, 0))[0] + n, now
        self.state.update(tuple(map(list, zip(*[(*pair, *c) for pair, c in counts.items()], strict=True))))
        known = Counter(k for k, _ in counts)
        yield pd.DataFrame([(k, kind, counts[k, kind][0], known[k]) for k, kind in more], columns=["key", "kind", "n", "known"])

    def close(self) -> None:
        pass


def running_kinds(stream: DataFrame, key: str = "user_id", kind: str = "event_type", forget: int | None = None, buckets: int = 1024) -> DataFrame:
    """(key, kind, n, known): after each micro-batch the rows so far of the kinds it touched, and how many kinds the key has.

    forget: seconds of processing time after which a kind that no row touched
    counts as never seen; such a stream goes on until it is stopped, as time may
    always change it, so it has no end to run to. A null kind is the empty one.
    buckets: parts that the keys are dealt to by hash. What a bucket's keys have
    is one state, so that a key costs no calls of its own; give more for more keys.
    """
    own = F.col(key).cast("string").alias("key")  # a number that may be null would lose digits in pandas
    rows = stream.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), own, F.coalesce(kind, F.lit("")).alias("kind")).groupBy("bucket")
    out = rows.transformWithStateInPandas(_Kinds(None if forget is None else 1000 * forget), "key string, kind string, n bigint, known bigint", "append", "None" if forget is None else "ProcessingTime")
    return out.select(F.col("key").cast(dict(stream.dtypes)[key]).alias(key), F.col("kind").alias(kind), "n", "known")
