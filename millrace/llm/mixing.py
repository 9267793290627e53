"""Mixing sources to target weights, in DataFrame functions only.

Words of each source, documents one after another, are cut into blocks of
BLOCK words, fewer in sources of few words so that these meet their targets as
closely. Each output shard of SHARD slots draws a multinomial source for
every slot; slots that a source got beyond its quota go to sources that are
short of theirs, so that totals meet the targets. The j-th slot of a source
takes the block whose place in the source's pseudorandom permutation is
j mod (its blocks), so a block comes again only after all others. Slots and
blocks are joined by that index.

Nothing is ordered or gathered by source alone: prefix sums and ranks have two
levels, buckets by hash, or groups of shards, and then within one. Only the
sources themselves, one row each, are ordered in one task. Texts are read once,
for their sizes; what is shuffled are ids and numbers.

Defined cases: a null text has size 0; sizes of 0 are never taken; a null
source is a source, the last one; no words at all give targets of 0; repeated
rows are documents of their own; other columns are ignored. All hashes are of
ids and positions, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, spread, written

BLOCK = 128
#: A source, or its target if that is less, has so many blocks at least, where BLOCK allows for it, and blocks of FINE words don't.
BLOCKS, FINE = 128, 16
SHARD = 4096
WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more often than this.
EPOCHS = 3
#: Least rows of a bucket, about; of n rows a bucket holds the square root of n where that is more.
BUCKET_ROWS = 256
#: Cells of a guide table for locating values in intervals.
CELLS = 1024


def hashed(seed: str, *parts: Column | str) -> Column:
    """60 bits of the md5 of seed:part:part."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS) -> DataFrame:
    """sources (source, size) with idx, weight and target: shares by weight, none above most * size.

    Sorted by most * size / weight, the sources that stop at their limit come
    first; the rest share what is left by weight.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("idx", F.row_number().over(by_name).cast("long") - 1).withColumn("weight", pick.cast("double"))
    by_limit = W.orderBy((F.col("size") * most / F.col("weight")).asc(), "idx")
    up_to = by_limit.rowsBetween(W.unboundedPreceding, -1)
    limit = F.col("size") * most
    left = F.sum("size").over(W.partitionBy()) - F.coalesce(F.sum(limit).over(up_to), F.lit(0))
    level = left / F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("stops", limit <= F.col("level") * F.col("weight"))
    rows = rows.withColumn("level", F.first(F.when(~F.col("stops"), F.col("level")), True).over(by_limit.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("stops"), limit.cast("double")).otherwise(F.col("level") * F.col("weight"))
    return rows.select("source", "idx", "size", target.alias("target"))


def text_key(text: Column) -> Column:
    """60 bits of a text's md5; -1 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1))


def sized(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(id, source, size, k) of every row; k stands for the text."""
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return rows.select("id", "source", size.alias("size"), text_key(F.col("text")).alias("k"))


def _located(rows: DataFrame, value: str, owners: DataFrame, low: str, count: str, total: int) -> DataFrame:
    """rows with the columns of the owner whose [low, low + count) holds value: an equi-join on cells of values."""
    width = max(1, -(-total // CELLS))
    last = F.col(low) + F.col(count) - 1
    guide = owners.filter(F.col(count) > 0).withColumn("cell", F.explode(F.sequence(F.expr(f"{low} div {width}"), F.floor(last / width))))
    found = rows.withColumn("cell", F.expr(f"{value} div {width}")).join(guide, "cell")
    return found.filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(low) + F.col(count))).drop("cell")


def _buckets(rows: int) -> int:
    """So many that neither a bucket nor the list of a source's buckets is long."""
    return max(1, rows // max(BUCKET_ROWS, isqrt(rows)))


@dataclass
class Mix:
    sources: DataFrame  # source, idx, size, target, unit (words of a block), blocks, quota
    docs: DataFrame  # id, source, size, k, idx, unit, start: the document's first word in its source
    slots: DataFrame  # shard, slot, idx, block


def plan(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> Mix:
    """Which block of which source each output slot takes. docs: from sized(), written."""
    spark = docs.sparkSession
    sources = targets(docs.groupBy("source").agg(F.sum("size").alias("size")))
    few = F.least(F.floor("target"), F.col("size")).cast("long")
    fine = F.least(F.greatest(F.expr(f"size div {BLOCKS}"), F.lit(1)), F.lit(min(FINE, block)))
    unit = F.least(F.greatest(F.floor(few / BLOCKS), fine), F.lit(block)).cast("long")
    sources = sources.withColumn("unit", unit)
    blocks = F.ceil(F.col("size") / F.col("unit")).cast("long")
    quota = F.when(F.col("size") > 0, F.least(blocks * EPOCHS, F.round(F.col("target") / F.col("size") * blocks).cast("long"))).otherwise(F.lit(0).cast("long"))
    sources = sources.withColumn("blocks", blocks).withColumn("quota", quota)
    before = W.orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    sources = written(sources.withColumn("quota_low", upto("quota")).withColumn("block_low", upto("blocks")), "mix-sources")
    n_docs = docs.count()
    totals = sources.agg(F.sum("quota"), F.sum("blocks")).first()
    n_slots, n_blocks = int(totals[0] or 0), int(totals[1] or 0)

    # where each document begins in its source: documents by bucket, within it by id, size and text
    placed = docs.join(sources.select(F.col("source").alias("name"), "idx", "unit"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    placed = placed.withColumn("bucket", F.pmod(hashed("doc", "id", "k"), F.lit(_buckets(n_docs))))
    inside = W.partitionBy("idx", "bucket").orderBy("id", "size", "k").rowsBetween(W.unboundedPreceding, -1)
    buckets = placed.groupBy("idx", "bucket").agg(F.sum("size").alias("n"))
    buckets = buckets.select("idx", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("idx").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("low"))
    start = (F.col("low") + F.coalesce(F.sum("size").over(inside), F.lit(0))).cast("long")
    placed = placed.join(buckets, ["idx", "bucket"]).withColumn("start", start).drop("bucket", "low")

    # each slot draws a source; its number among the source's slots follows from counts by shard
    drawn = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(f"id div {shard}").alias("shard"), F.pmod(hashed("slot", "id"), F.lit(max(1, n_slots))).alias("v"))
    drawn = _located(drawn, "v", sources.select("idx", "quota", "quota_low"), "quota_low", "quota", n_slots).select("slot", "shard", "idx", "quota")
    # two levels: a source's groups of shards, the shards of a group
    counts = drawn.groupBy("shard", "idx").agg(F.count("*").alias("n")).withColumn("group", F.expr(f"shard div {isqrt(n_slots // shard) + 1}"))
    groups = counts.groupBy("idx", "group").agg(F.sum("n").alias("n"))
    upto_here = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("idx", "group", upto_here(W.partitionBy("idx").orderBy("group")).alias("before"))
    counts = counts.withColumn("low", upto_here(W.partitionBy("idx", "group").orderBy("shard"))).join(groups, ["idx", "group"])
    counts = counts.select("shard", "idx", (F.col("before") + F.col("low")).alias("low"))
    rank = F.row_number().over(W.partitionBy("shard", "idx").orderBy("slot"))
    numbered = written(drawn.join(counts, ["shard", "idx"]).select("shard", "slot", "idx", "quota", (F.col("low") + rank - 1).cast("long").alias("j")), "mix-slots")

    # what is beyond a source's quota goes to those below theirs
    got = sources.join(numbered.groupBy("idx").agg(F.count("*").alias("got")), "idx", "left").select("idx", "quota", F.coalesce("got", F.lit(0)).alias("got"))
    got = got.withColumn("over", F.greatest(F.col("got") - F.col("quota"), F.lit(0))).withColumn("short", F.greatest(F.col("quota") - F.col("got"), F.lit(0)))
    got = written(got.withColumn("over_low", upto("over")).withColumn("short_low", upto("short")), "mix-got")
    n_over = int(got.agg(F.sum("over")).first()[0] or 0)
    kept = numbered.filter("j < quota").select("shard", "slot", "idx", "j")
    extra = numbered.filter("j >= quota").join(got.select("idx", "over_low"), "idx").select("shard", "slot", (F.col("over_low") + F.col("j") - F.col("quota")).alias("m"))
    moved = _located(extra, "m", got.select("idx", "got", "short", "short_low"), "short_low", "short", n_over)
    moved = moved.select("shard", "slot", "idx", (F.col("got") + F.col("m") - F.col("short_low")).alias("j"))
    slots = kept.unionByName(moved).join(sources.select("idx", "blocks"), "idx").withColumn("place", F.col("j") % F.col("blocks")).drop("blocks")

    # places of blocks in their source's permutation: by bucket of the hash, within it by the hash
    each = _located(spark.range(n_blocks).withColumnRenamed("id", "v"), "v", sources.select("idx", "blocks", "block_low"), "block_low", "blocks", n_blocks)
    each = each.select("idx", (F.col("v") - F.col("block_low")).alias("block")).withColumn("h", hashed("block", "idx", "block"))
    each = each.withColumn("bucket", F.pmod("h", F.lit(_buckets(n_blocks))))
    heads = each.groupBy("idx", "bucket").agg(F.count("*").alias("n"))
    heads = heads.select("idx", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("idx").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("low"))
    place = F.row_number().over(W.partitionBy("idx", "bucket").orderBy("h", "block"))
    permuted = each.join(heads, ["idx", "bucket"]).select("idx", "block", (F.col("low") + place - 1).cast("long").alias("place"))
    return Mix(sources, placed, slots.join(permuted, ["idx", "place"]).select("shard", "slot", "idx", "block"))


def taken(mix: Mix) -> DataFrame:
    """(id, k, size, source_size, target, taken) of every document: the words of its blocks, as often as slots take them."""
    times = mix.slots.groupBy("idx", "block").agg(F.count("*").alias("times"))
    first, last = F.expr("start div unit"), F.expr("(start + size - 1) div unit")
    pieces = mix.docs.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("unit")) - F.greatest(F.col("start"), F.col("block") * F.col("unit"))
    pieces = pieces.join(times, ["idx", "block"], "left").withColumn("words", F.coalesce(words * F.col("times"), F.lit(0)))
    rows = pieces.groupBy("idx", "start", "id", "k", "size").agg(F.sum("words").cast("long").alias("taken"))
    # of rows of size 0 several may begin at one word: they are counted, not merged
    rows = rows.filter("size > 0").unionByName(mix.docs.filter("size = 0").select("idx", "start", "id", "k", "size", F.lit(0).cast("long").alias("taken")))
    return rows.join(mix.sources.select("idx", F.col("size").alias("source_size"), "target"), "idx")


def mix_documents(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(id, size, source_size, target, taken) of every document."""
    docs = written(sized(df, text, source, id_col), "mix-docs")
    return taken(plan(docs)).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def sampled_documents(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The mixed corpus as whole documents: df's rows, each as often as taken / size, rounded by a hash of its id.

    A document of which nothing is taken, or without words, is left out; no
    document comes more than EPOCHS times for each of its rows.
    """
    docs = written(sized(df, text, source, id_col), "mix-docs")
    rows = taken(plan(docs)).filter("taken > 0")
    times = F.floor(F.col("taken") / F.col("size") + (hashed("copies", "id") % 1_000_000) / 1_000_000)
    keys = lambda i, k: {"__k1": F.xxhash64(F.isnull(i), i, k), "__k2": F.xxhash64(F.lit(1), k, i, F.isnull(i))}  # noqa: E731  no nulls, so that texts are dealt once
    copies = rows.select(times.alias("n"), *[c.alias(n) for n, c in keys(F.col("id"), F.col("k")).items()]).groupBy("__k1", "__k2").agg(F.sum("n").cast("int").alias("__n")).filter("__n > 0")
    keyed = df.withColumns(keys(F.col(id_col), text_key(F.col(text)))).dropDuplicates(["__k1", "__k2"])
    out = keyed.join(copies, ["__k1", "__k2"])
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(df.columns)
