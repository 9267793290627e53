"""Sketches as stored columns: made for each part of a table, kept, and merged for any set of parts later.

A stored table has a row for each part and group, with a HyperLogLog and a theta
sketch of a column's distinct values and a KLL sketch of a measure; its size
follows from the parts, not the rows. Merging is a sum over few small rows, so
hot groups cost no more than others. Null values are in no sketch; a group whose
values all are null has empty sketches or, for KLL, a null one.

Stated errors, three deviations each: HyperLogLog with 2**LOG_K registers 3 *
1.04 / 2**(LOG_K / 2); theta with 2**LOG_K entries 3 / 2**(LOG_K / 2) of the
union that a set expression is over; KLL with its default size 2 % of ranks;
frequent items FREQUENT / (items / 0.75) of all rows, where that is a power of 2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

LOG_K = 14
HLL_ERROR, THETA_ERROR, KLL_ERROR = 3 * 1.04 / 2 ** (LOG_K / 2), 3 / 2 ** (LOG_K / 2), 0.02
#: Frequent items: the most that a count is off, times the map's size, over all rows.
FREQUENT = 3.5


def stored(df: DataFrame, by: Sequence[str], counted: str, measure: str) -> DataFrame:
    """(by.., hll, theta, kll), written: sketches of the distinct values of `counted` and of the distribution of `measure`."""
    x = F.col(measure).cast("double")
    sketches = df.groupBy(*by).agg(F.hll_sketch_agg(counted, F.lit(LOG_K)).alias("hll"), F.theta_sketch_agg(counted, LOG_K).alias("theta"), F.kll_sketch_agg_double(x).alias("kll"))
    return written(sketches, "sketches")


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., hll, theta, kll) of larger parts."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", F.lit(LOG_K)).alias("theta"), F.kll_merge_agg_double("kll").alias("kll"))


def either(sketches: DataFrame, condition: Column) -> Column:
    """The union of the theta sketches of the rows that a condition holds for; an aggregate."""
    return F.theta_union_agg(F.when(condition, F.col("theta")), F.lit(LOG_K))


def frequent_items(df: DataFrame, by: Sequence[str], item: str, tracked: int) -> DataFrame:
    """(by.., items), written: the state of a frequent-items sketch for each part."""
    return written(df.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate({item}, {tracked})").alias("items")), "items")


def top_items(states: DataFrame, k: int, tracked: int) -> DataFrame:
    """(item, count) of the k most frequent items over all stored parts, by the merged sketch."""
    top = states.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(items, {tracked}), {k})").alias("t"))
    return top.select(F.inline("t")).select("item", "count")
