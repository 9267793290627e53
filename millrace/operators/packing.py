"""Token packing: documents as runs of tokens, cut or binned into sequences of a fixed length.

A document of n words counts n + 1 tokens: its words and one end mark. Blocks
are cut from the documents of a shard in order; a document may cross blocks.
Where a document begins is a running sum over ranges of its shard, so that a
shard is never in one task.

Defined cases: a null text has no words and is one end mark; null shards are
one shard, null keys come first; documents of one key follow each other by
length, then by a hash of their text where there is one; repeated rows are
documents of their own; an empty table gives no row; columns beyond the named
ones are ignored, whatever their names.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import spread, written
from .ranges import last_known, running, sums_before

END = "<eos>"


def lengths(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n, its tokens with the end mark."""
    return df.withColumn("n", F.coalesce(T.word_count(text), F.lit(0)) + 1)


def _begin(df: DataFrame, shard: str | None, order: str) -> DataFrame:
    """(_s, _o, n, begin) of every row: its shard, key, tokens and first token in the shard."""
    rows = df.select((F.col(shard) if shard else F.lit(0)).alias("_s"), F.col(order).alias("_o"), F.col("n").cast("long").alias("n"))
    return sums_before(rows, "n", ("_s",) if shard else (), [F.asc_nulls_first("_o"), F.col("n")], "begin")


def _chunks(length: int) -> tuple[Column, Column]:
    return F.expr(f"begin div {length}"), F.expr(f"(begin + n - 1) div {length}")


def spans(df: DataFrame, length: int, shard: str = "source", order: str = "doc_id") -> DataFrame:
    """A row for each piece of a document in a block: (shard, chunk, order, start, len, pos)."""
    cut = _begin(df, shard, order).withColumn("chunk", F.explode(F.sequence(*_chunks(length))))
    low = F.greatest("begin", F.col("chunk") * length)
    high = F.least(F.col("begin") + F.col("n"), (F.col("chunk") + 1) * length)
    return cut.select(F.col("_s").alias(shard), "chunk", F.col("_o").alias(order), (low - F.col("chunk") * length).alias("start"), (high - low).alias("len"), (low - F.col("begin")).alias("pos"))


def _filled(placed: DataFrame, length: int) -> DataFrame:
    """(_s, chunk, segs, ntok) of every block that the placed documents fill."""
    cut = placed.withColumn("chunk", F.explode(F.sequence(*_chunks(length))))
    took = F.least(F.col("begin") + F.col("n"), (F.col("chunk") + 1) * length) - F.greatest("begin", F.col("chunk") * length)
    return cut.groupBy("_s", "chunk").agg(F.count("*").alias("segs"), F.sum(took).cast("long").alias("ntok"))


def pack_spans(df: DataFrame, length: int, shard: str = "source", order: str = "doc_id") -> DataFrame:
    """(shard, chunk, segs, ntok) of every block."""
    return _filled(_begin(df, shard, order), length).withColumnRenamed("_s", shard)


def pack_tokens(df: DataFrame, length: int, text: str = "text", shard: str = "source", order: str = "doc_id") -> DataFrame:
    """(shard, chunk, n, tokens) of every block, the tokens in order.

    Equal rows are placed as one run by their key and a hash of their text, and
    numbered, so that each of them finds its own place; texts are dealt by that
    key once, their pieces by block once more.
    """
    rows = spread(df.select(F.col(shard).alias("_s"), F.col(order).alias("_o"), F.col(text).alias("_t")))
    known = [F.col("_s").isNull(), F.col("_o").isNull(), F.col("_t").isNull(), F.col("_s"), F.col("_o"), F.col("_t")]
    keyed = rows.withColumns({"_k": F.xxhash64(*known), "_h": F.xxhash64(F.lit(1), *reversed(known))})
    runs = keyed.select("_s", "_o", "_k", "_h", (F.coalesce(T.word_count("_t"), F.lit(0)) + 1).alias("n")).groupBy("_s", "_o", "_k", "_h", "n").agg(F.count("*").alias("_c"))
    runs = sums_before(runs.withColumn("_all", F.col("n") * F.col("_c")), "_all", ("_s",), [F.asc_nulls_first("_o"), F.col("n"), F.col("_k"), F.col("_h")], "begin")
    number = F.row_number().over(W.partitionBy("_k", "_h").orderBy("_k")) - 1
    placed = keyed.withColumn("_i", number).join(runs.select("_k", "_h", "n", F.col("begin").alias("_first")), ["_k", "_h"])
    placed = placed.withColumn("begin", F.col("_first") + F.col("_i") * F.col("n"))
    tokens = F.concat(F.coalesce(T.words("_t"), F.expr("cast(array() as array<string>)")), F.array(F.lit(END)))

    def pieces(t: Column) -> Column:
        low = lambda c: F.greatest(F.col("begin"), c * length)
        high = lambda c: F.least(F.col("begin") + F.col("n"), (c + 1) * length)
        cut = lambda c: F.slice(t, (low(c) - F.col("begin") + 1).cast("int"), (high(c) - low(c)).cast("int"))
        return F.transform(F.sequence(*_chunks(length)), lambda c: F.struct(c.alias("chunk"), (low(c) - c * length).alias("start"), cut(c).alias("piece")))

    each = placed.select("_s", F.inline(F.transform(F.array(tokens), pieces)[0]))  # the words of a text are cut once
    blocks = each.groupBy("_s", "chunk").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("pieces"))
    return blocks.select(F.col("_s").alias(shard), "chunk", F.flatten(F.transform("pieces", lambda p: p["piece"])).alias("tokens")).withColumn("n", F.size("tokens").cast("long"))


def segment_map(df: DataFrame, length: int, shard: str = "source", order: str = "doc_id") -> DataFrame:
    """(shard, chunk, segment, order, start, len): segments of a block, numbered, for attention within documents."""
    number = F.row_number().over(W.partitionBy(shard, "chunk").orderBy("start")).cast("long")  # `length` rows at most
    return spans(df, length, shard, order).withColumn("segment", number).select(shard, "chunk", "segment", order, "start", "len")


def pack_drop_last(df: DataFrame, length: int, shard: str = "source", order: str = "doc_id") -> DataFrame:
    return pack_spans(df, length, shard, order).filter(F.col("ntok") == length)


def pack_stats(df: DataFrame, length: int, shard: str = "source", order: str = "doc_id") -> DataFrame:
    """(shard, n_seq, n_tok, pad, n_split_docs, fill) of P1's blocks."""
    first, last = _chunks(length)
    out = _begin(df, shard, order).groupBy(F.col("_s").alias(shard)).agg((F.max(last) + 1).alias("n_seq"), F.sum("n").cast("long").alias("n_tok"), F.count(F.when(last > first, 1)).alias("n_split_docs"))
    return out.select(shard, "n_seq", "n_tok", (F.col("n_seq") * length - F.col("n_tok")).alias("pad"), "n_split_docs", F.round(F.col("n_tok") / (F.col("n_seq") * length), 6).alias("fill"))


def pad_truncate(df: DataFrame, length: int, text: str = "text", key: str = "doc_id", pad: str = "<pad>") -> DataFrame:
    """(key, kept, tokens): one document a row, cut or padded to length."""
    tokens = F.concat(F.coalesce(F.slice(T.words(text), 1, length - 1), F.expr("cast(array() as array<string>)")), F.array(F.lit(END)))
    out = df.select(key, tokens.alias("tokens"))
    return out.select(key, F.size("tokens").cast("long").alias("kept"), F.concat("tokens", F.array_repeat(F.lit(pad), length - F.size("tokens"))).alias("tokens"))


def pack_global(df: DataFrame, length: int, order: str = "doc_id") -> DataFrame:
    """(chunk, segs, ntok) over one order of all documents."""
    return _filled(_begin(df, None, order), length).drop("_s")


#: A stretch of equally long documents: those from rank `first` on go to bins from `bin` on, `per` to each.
_STRETCHES = "len bigint, first bigint, bin bigint, per bigint"


def first_fit(counts: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(stretches, bins) of first fit over (len, count), longest first.

    Documents of one length are interchangeable, and so are neighbouring bins of
    one room: each run of such bins takes as many documents as fit into every one
    of them. A length splits one run at most, so there are few.
    """
    runs: list[tuple[int, int, int]] = []  # (first bin, bins, room) in the order of bins
    out, bins, least = [], 0, min((n for n, _ in counts), default=0)
    for n, count in counts:
        if n <= 0:  # takes no room: the first bin
            out.append((n, 0, 0, count))
            bins = max(bins, 1)
            continue
        at, after = 0, []
        for begin, many, room in [*runs, (bins, -(-count // (length // n)), length)]:
            per = room // n
            took = min(many * per, count - at)
            if not took:
                if begin < bins:
                    after.append((begin, many, room))
                continue
            out.append((n, at, begin, per))
            at += took
            full, rest = divmod(took, per)
            pieces = [(begin, full, room - per * n), (begin + full, int(rest > 0), room - rest * n), (begin + full + (rest > 0), many - full - (rest > 0), room)]
            if begin == bins:
                bins += full + (rest > 0)
                pieces.pop()
            after += [p for p in pieces if p[1]]
        runs = [r for r in after if r[2] >= least]
    return out, bins


def best_fit(counts: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """As first_fit, but each document goes to the bin it fills most, of equals the first.

    A bin that takes one document takes more of that length until none fits, as
    it has the least room of all that would do; bins of one room take turns in
    the order of their numbers.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room: runs (first bin, bins), sorted
    out, bins = [], 0
    for n, count in counts:
        if n <= 0:
            continue
        at = 0

        def fill(begin: int, many: int, room: int, n: int = n, count: int = count) -> int:
            """Bins of a run that get documents."""
            nonlocal at
            per = room // n
            took = min(many * per, count - at)
            out.append((n, at, begin, per))
            at += took
            full, rest = divmod(took, per)
            for first, some, left in ((begin, full, room - per * n), (begin + full, int(rest > 0), room - rest * n)):
                if some and left:
                    bisect.insort(rooms.setdefault(left, []), (first, some))
            return full + (rest > 0)

        for room in sorted(r for r in rooms if r >= n):
            if at == count:
                break
            runs, kept = rooms.pop(room), []
            for begin, many in runs:
                used = fill(begin, many, room) if at < count else 0
                if used < many:
                    kept.append((begin + used, many - used))
            if kept:
                rooms[room] = sorted([*kept, *rooms.get(room, [])])
        if at < count:
            bins += fill(bins, -(-(count - at) // (length // n)), length)
    return out, bins


def _stretches(pieces: DataFrame, length: int, fit) -> DataFrame:
    """(_s, len, first, bin, per), written, of pieces (_s, len, ..), and a row of length null with all bins of a shard.

    A task gets the histogram of a shard's lengths: a row for each length.
    """
    kinds = dict(pieces.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, bins = fit(sorted(zip(pdf["len"].tolist(), pdf["count"].tolist(), strict=True), reverse=True), length)
        own = None if pd.isna(pdf["_s"].iloc[0]) else pdf["_s"].iloc[0]
        out = pd.DataFrame([*found, (None, 0, bins, 1)], columns=["len", "first", "bin", "per"]).astype("Int64")
        return out.assign(_s=own)[["_s", "len", "first", "bin", "per"]]

    counts = pieces.groupBy("_s", "len").count()
    return written(counts.groupBy("_s").applyInPandas(run, f"_s {kinds['_s']}, {_STRETCHES}"), "stretches")


def _placed(pieces: DataFrame, stretches: DataFrame) -> DataFrame:
    """(_s, _o, part, len, bin): pieces by key among those of their length take the places of its stretches."""
    ranked = sums_before(pieces.withColumn("_one", F.lit(1)), "_one", ("_s", "len"), [F.asc_nulls_first("_o"), F.col("part")], "rank").withColumn("_side", F.lit(1))
    where = stretches.filter("len is not null").select("_s", "len", F.col("first").alias("rank"), F.struct("first", "bin", "per").alias("_to"), F.lit(0).alias("_side"))
    both = ranked.drop("_one").unionByName(where, allowMissingColumns=True)
    found = running(both, ("_s", "len"), ["rank", "_side"], {"_at": last_known(F.col("_to"))}).filter("_side = 1")
    return found.select("_s", "_o", "part", "len", F.expr("_at.bin + (rank - _at.first) div _at.per").alias("bin"))


def _cut(df: DataFrame, shard: str, order: str) -> DataFrame:
    return df.select(F.col(shard).alias("_s"), F.col(order).alias("_o"), F.col("n").cast("long").alias("n"))


def pack_ffd(df: DataFrame, length: int, shard: str = "source", order: str = "doc_id") -> DataFrame:
    """(shard, bin, order, part, len): whole documents by first fit, longest first, ties by order.

    A document longer than a bin is cut into parts, each with a bin of its own;
    bins of further parts are numbered after all others. Bins depend on lengths
    only: first fit runs over a shard's histogram of them, and documents take
    their places by rank among those of their length, dealt by ranges.
    """
    rows = _cut(df, shard, order)
    pieces = rows.select("_s", "_o", F.lit(0).cast("long").alias("part"), F.least("n", F.lit(length)).alias("len"))
    stretches = _stretches(pieces, length, first_fit)
    more = sums_before(rows.filter(F.col("n") > length).withColumn("_more", F.ceil(F.col("n") / length) - 1), "_more", ("_s",), [F.asc_nulls_first("_o"), F.col("n")], "_before")
    tops = stretches.filter("len is null").select(F.col("_s").alias("_shard"), F.col("bin").alias("_top"))
    part = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_more"))).alias("part")
    more = more.join(tops, F.col("_s").eqNullSafe(F.col("_shard"))).select("_s", "_o", "n", "_top", "_before", part)
    more = more.select("_s", "_o", "part", F.least(F.lit(length), F.col("n") - F.col("part") * length).alias("len"), (F.col("_top") + F.col("_before") + F.col("part") - 1).alias("bin"))
    both = _placed(pieces, stretches).unionByName(more)
    return both.select(F.col("_s").alias(shard), "bin", F.col("_o").alias(order), "part", "len")


def pack_bfd(df: DataFrame, length: int, shard: str = "source", order: str = "doc_id") -> DataFrame:
    """As pack_ffd, but documents longer than a bin are split, and each piece goes to the bin it fills most."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / length) - 1)).alias("part")
    pieces = _cut(df, shard, order).filter("n > 0").select("_s", "_o", "n", part)
    pieces = pieces.select("_s", "_o", "part", F.least(F.lit(length), F.col("n") - F.col("part") * length).alias("len"))
    both = _placed(pieces, _stretches(pieces, length, best_fit))
    return both.select(F.col("_s").alias(shard), "bin", F.col("_o").alias(order), "part", "len")


def length_bucket(df: DataFrame, bounds: tuple[int, ...]) -> DataFrame:
    """(bucket, n_docs, n_tok, padded): documents by length, the tokens they take padded to their bucket's longest."""
    bucket = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col("n") <= bounds[k], k).otherwise(bucket)
    out = df.withColumn("bucket", bucket.cast("long")).groupBy("bucket").agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("n_tok"), F.max("n").alias("longest"))
    return out.select("bucket", "n_docs", "n_tok", (F.col("n_docs") * F.col("longest")).alias("padded"))
