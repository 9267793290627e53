"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A fingerprint holds every 48-bit hash of a 5-word shingle that lies below
2**48 / SCALE, in order, and no other. Fingerprints of one SCALE can be merged
by union, which gives the fingerprint of both texts together, and the share of
one's hashes found in another estimates containment between documents of very
unequal lengths. The estimate's error falls with the number of hashes: a text of
n shingles has n / SCALE on average, and none by chance (1 - 1 / SCALE)**n.

Words are runs of anything but ASCII white space; fewer than five are one
shingle. Defined cases: null and empty texts and texts without a word have the
empty fingerprint, as have texts without a hash below the threshold; where one of
two fingerprints is empty, equal texts and two without a word are alike (1), all
others are not (0); repeated rows stay; documents of one id follow each other by a hash of the text; null ids come
last; other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, spread, written

WORDS = 5
#: One of so many shingle hashes is kept.
SCALE = 2
BITS = 48
#: Bytes of text in a range of neighbours, about; and most ranges.
RANGE_BYTES = 256 << 10
MOST_RANGES = 1 << 15
#: Stands for a null id where ranges are cut.
LOWEST = -(1 << 63)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """array<bigint> of all shingle hashes. The words are bound by transform over a one-element array, so they are cut once."""
    cut = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1)))
        each = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, words)), 64 - BITS))
        return F.when(F.size(w) > 0, each).otherwise(F.expr("cast(array() as array<bigint>)"))

    return F.transform(F.array(cut), hashes)[0]


def sketch(text: Column, scale: int = SCALE) -> Column:
    """The fingerprint of a text, array<bigint> in order."""

    def low(all_: Column) -> Column:
        return F.sort_array(F.array_distinct(F.filter(all_, lambda h: h < (1 << BITS) // scale)))

    return F.transform(F.array(shingle_hashes(text)), low)[0]


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of both documents together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column, alike: Column | bool = False) -> Column:
    """Estimated share of the smaller document's shingles that the other has, 0 to 1.

    An empty fingerprint says nothing of its shingles: then it is 1 if the
    documents are known to be `alike`, and 0 otherwise.
    """
    least = F.least(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)) / least
    return F.when(least > 0, both).otherwise((F.lit(alike) if isinstance(alike, bool) else alike).cast("double"))


def _alike(text: Column, other: Column) -> Column:
    """Whether two texts are the same, or neither has a word."""
    return (text == other) | ~(text.rlike(WORD) | other.rlike(WORD))


def as_string(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.hex(h)), ",")


def edited(text: Column, next_text: Column) -> Column:
    """text with its last half replaced by as many of the first characters of next_text, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def _rank(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most value, found in two steps."""
    all_ = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to one literal
    if len(bounds) <= 64:
        return F.size(F.filter(all_, lambda x: x <= value))
    width = isqrt(len(bounds)) + 1
    firsts = F.split(F.lit(",".join(map(str, bounds[::width]))), ",").cast("array<bigint>")
    block = F.size(F.filter(firsts, lambda x: x <= value))
    within = F.size(F.filter(F.slice(all_, F.greatest(block - 1, F.lit(0)) * width + 1, F.lit(width)), lambda x: x <= value))
    return F.when(block == 0, 0).otherwise((block - 1) * width + within)


def in_ranges(df: DataFrame) -> DataFrame:
    """(id, text, z, range) of rows (id, text): z descends in the order of documents, ranges ascend.

    Ranges are cut at quantiles of the ids, so that they hold about as many
    rows however ids are spread. An id that fills several (nulls count as one)
    is cut further by the hash of the text.
    """
    spark = df.sparkSession
    own = F.coalesce("id", F.lit(LOWEST))
    size = df.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(1, min(MOST_RANGES, size["n"], (size["bytes"] or 0) // RANGE_BYTES))
    found = df.agg(F.percentile_approx(own, [i / n for i in range(1, n)], max(10_000, 8 * n)).alias("q")).first()["q"] if n > 1 else []
    bounds = sorted(set(found))
    times = {b: found.count(b) for b in bounds} if len(bounds) < len(found) else {}
    heavy = [b for b in bounds if times.get(b, 1) > 1]
    k = F.xxhash64("text")
    place, most = F.lit(0).cast("long"), max(times.values(), default=1)
    if bounds:
        place = (len(bounds) - _rank(own, bounds)).cast("long") * (most + 1)
    if heavy:
        parts = F.split(F.lit(",".join(str(times[b]) for b in heavy)), ",").cast("array<bigint>")
        which = F.array_position(F.split(F.lit(",".join(map(str, heavy))), ",").cast("array<bigint>"), own).cast("int")
        share = F.shiftright(k, 32) + (1 << 31)  # 32 bits, in the order of k
        place = place + F.when(which > 0, 1 + F.floor(share * F.get(parts, which - 1) / float(1 << 32))).otherwise(F.lit(0))
    z = F.struct(F.col("id").isNotNull().alias("has"), F.coalesce("id", F.lit(0)).alias("id"), F.bitwise_not(k).alias("k"))
    return df.select("id", "text", z.alias("z"), place.cast("long").alias("range"))


def _with_next(df: DataFrame, name: str, value: Column) -> DataFrame:
    """(id, text) with name, value made from the text, and both of the row that follows by descending id as next_text, next_<name>; after the last comes the first.

    The first row of a range also stands, marked, at the end of the range before.
    """
    rows = in_ranges(df)
    tops = rows.groupBy("range").agg(F.max("z").alias("top"))
    before = F.lag("range").over(W.orderBy("range"))
    last = F.last("range").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    tops = written(tops.select(F.col("range").alias("own"), "top", F.coalesce(before, last).alias("to")), "range-tops")  # a row for each range
    firsts = rows.join(F.broadcast(tops), (F.col("range") == F.col("own")) & (F.col("z") == F.col("top"))).dropDuplicates(["own"])
    both = rows.withColumn("copy", F.lit(0)).unionByName(firsts.select("id", "text", "z", F.col("to").alias("range"), F.lit(1).alias("copy")))
    both = both.repartition("range").withColumn(name, value)  # after the texts have been dealt, so that only these are
    follows = W.partitionBy("range").orderBy("copy", F.desc("z"))
    both = both.select("*", *[F.lead(c).over(follows).alias(f"next_{c}") for c in ("text", name)])
    return both.filter("copy = 0").drop("copy", "range", "z")


def compare_with_next(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    rows = _with_next(rows, "print", sketch(F.col("text")))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "print", "next_print", sketch(F.col("edited")).alias("edited_print"), *[_alike(F.col("text"), F.col(c)).alias(f"{c}_alike") for c in ("edited", "next_text")])
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_string(F.col("print")).alias("fingerprint"),
        as_string(F.col("edited_print")).alias("edited_fingerprint"),
        F.round(containment(F.col("print"), F.col("edited_print"), F.col("edited_alike")), 9).alias("near_edited"),
        F.round(containment(F.col("print"), F.col("next_print"), F.col("next_text_alike")), 9).alias("near_next"),
    )
