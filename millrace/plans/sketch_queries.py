"""Stored and merged sketches against exact figures, each within its stated error."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators import sketches as K
from ..sources.tables import table
from .registry import registry

QUERIES, SQL, query = registry()


def _months(spark, d):
    li = table(spark, d, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month"), "l_returnflag", "l_partkey", "l_extendedprice")
    return li, K.stored(li, ("month", "l_returnflag"), "l_partkey", "l_extendedprice")


def _near(found, exact, share, of=None):
    return F.abs(F.col(found) - F.col(exact)) <= share * F.col(of or exact) + 1


@query("SELECT l_returnflag, year(l_shipdate) AS y, count(DISTINCT l_partkey) AS parts, true AS hll_near, true AS theta_near, count(*) AS lines, true AS lines_same, true AS mid_near FROM lineitem GROUP BY ALL")
def sketch_merge(spark, d):
    """Monthly sketches, stored, merged to years: distinct parts, and the middle price between the exact ranks around it."""
    li, months = _months(spark, d)
    years = K.merged(months.withColumn("y", F.year("month").cast("long")), ("l_returnflag", "y"))
    by = ("l_returnflag", "y")
    exact = li.withColumn("y", F.year("month").cast("long"))
    around = R.percentiles(exact, by, "l_extendedprice", {"low": 0.5 - K.KLL_ERROR, "high": 0.5 + K.KLL_ERROR})
    exact = exact.groupBy(*by).agg(F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("lines"))
    found = years.select(*by, F.hll_sketch_estimate("hll").alias("hll"), F.theta_sketch_estimate("theta").alias("theta"), F.kll_sketch_get_n_double("kll").alias("n"), F.kll_sketch_get_quantile_double("kll", F.lit(0.5)).alias("mid"))
    both = exact.join(found, list(by)).join(around, list(by))  # a row for each flag and year
    return both.select(*by, "parts", _near("hll", "parts", K.HLL_ERROR).alias("hll_near"), _near("theta", "parts", K.THETA_ERROR).alias("theta_near"), "lines", (F.col("n") == F.col("lines")).alias("lines_same"), F.col("mid").between(F.col("low"), F.col("high")).alias("mid_near"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND year(l_shipdate) < 1995), n AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'N' AND month(l_shipdate) = 1)
SELECT (SELECT count(*) FROM a SEMI JOIN r USING (k)) AS both_, true AS both_near, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM r) SEMI JOIN n USING (k)) AS all_three, true AS three_near, (SELECT count(*) FROM r ANTI JOIN n USING (k)) AS only_r, true AS only_near""")
def sketch_sets(spark, d):
    """Set expressions over the stored months: parts returned before 1995 that were accepted as well, in any January besides, or in none."""
    li, months = _months(spark, d)
    flags = {"a": F.col("l_returnflag") == "A", "r": (F.col("l_returnflag") == "R") & (F.year("month") < 1995), "n": (F.col("l_returnflag") == "N") & (F.month("month") == 1)}
    sets = months.agg(*[K.either(months, c).alias(name) for name, c in flags.items()])
    size = lambda s: F.theta_sketch_estimate(s)
    both = F.theta_intersection("a", "r")
    found = sets.select(size(both).alias("f_both"), size(F.theta_intersection(both, "n")).alias("f_three"), size(F.theta_difference("r", "n")).alias("f_only"), size(F.theta_union(F.theta_union("a", "r"), "n")).alias("f_any"))
    held = li.groupBy("l_partkey").agg(*[F.bool_or(c).alias(name) for name, c in flags.items()])
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    a, r, n = F.col("a"), F.col("r"), F.col("n")
    exact = held.agg(count(a & r).alias("both_"), count(a & r & n).alias("all_three"), count(r & ~n).alias("only_r"))
    row = exact.crossJoin(found)  # one row each
    return row.select("both_", _near("f_both", "both_", K.THETA_ERROR, "f_any").alias("both_near"), "all_three", _near("f_three", "all_three", K.THETA_ERROR, "f_any").alias("three_near"), "only_r", _near("f_only", "only_r", K.THETA_ERROR, "f_any").alias("only_near"))


#: Items that a sketch tracks: fewer than the distinct words.
TRACKED = 192


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM documents)
SELECT word, count(*) AS n, true AS near FROM w GROUP BY word ORDER BY n DESC, word LIMIT 5""")
def sketch_top_words(spark, d):
    """The most frequent words, and whether sketches stored for each source and then merged know each of them and its count to their stated error."""
    words = table(spark, d, "documents").select("source", F.explode(T.words(F.lower("text"))).alias("word"))
    top = K.top_items(K.frequent_items(words, ("source",), "word", TRACKED), TRACKED, TRACKED).withColumnsRenamed({"item": "word", "count": "found"})
    exact = words.groupBy("word").agg(F.count("*").alias("n"))
    five = exact.orderBy(F.desc("n"), "word").limit(5)
    error = K.FREQUENT / (TRACKED / 0.75)
    total = exact.agg(F.sum("n").alias("total"))
    both = five.join(top, "word", "left").crossJoin(total)  # one row
    return both.select("word", "n", F.coalesce(F.abs(F.col("found") - F.col("n")) <= error * F.col("total"), F.lit(False)).alias("near"))
