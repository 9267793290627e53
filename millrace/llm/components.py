"""Connected components by alternating large-star and small-star steps on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written

#: Least edges in a file; small graphs are written by few tasks.
FILE_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root), written: for every node of edges (a, b), the smallest node it is connected with.

    Each step keeps at most as many edges as there were; it ends when the
    edges are stars around their smallest nodes. Loops and repeated edges do
    no harm.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    few, before = edges.count() // FILE_EDGES + 1, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("u <> v")
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(lowest.select("u", F.col("m").alias("v")))
        last, edges = edges, written(small.distinct().coalesce(few), "edges")
        remove(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = written(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).coalesce(few), "roots")
    remove(edges)
    return roots
