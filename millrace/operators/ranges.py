"""Running figures over an order (sums, the last known value), without one task that sees a whole group.

Rows are dealt by ranges of (group, order). What a figure comes to in each range
of a group is small and combined over the group's few ranges; each range then
goes on from what came before it. The dealt rows are written first, so that
ranges stay put when a task or an executor is lost; give keys and numbers only,
not texts. Rows that are equal in group and order are in one range, so give an
order that tells rows apart where many could be equal.

Names that begin with two underscores are reserved for what is added inside.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

PART, ROW = "__part", "__row"


class Scan(NamedTuple):
    """A running figure: any whose value over two stretches follows from the value over each (a monoid)."""

    inside: Callable[[WindowSpec], Column]  # within a range, up to a row
    total: Callable[[Column], Column]  # of a whole range; gets the number of a row in it
    across: Callable[[Column, WindowSpec], Column]  # of the totals of the ranges before
    joined: Callable[[Column, Column], Column]  # of what came before the range and what is inside
    numbered: bool = False  # whether total needs the number


def sums(value: Column) -> Scan:
    """The sum of value over the rows before, 0 for the first."""
    return Scan(
        lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        lambda row: F.sum(value),
        lambda total, w: F.coalesce(F.sum(total).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        lambda before, own: F.coalesce(before, F.lit(0)) + own,
    )


def last_known(value: Column) -> Scan:
    """The last value that isn't null, up to and with the row."""
    return Scan(
        lambda w: F.last(value, True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        lambda row: F.max_by(value, F.when(value.isNotNull(), row)),
        lambda total, w: F.last(total, True).over(w.rowsBetween(W.unboundedPreceding, -1)),
        lambda before, own: F.coalesce(own, before),
        True,
    )


def dealt(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """df, written, with PART: the range of (by, order) that a row is in. Later rows of a group are in the same or a later range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *[F.asc_nulls_first(c) for c in by], *order).withColumn(PART, F.spark_partition_id()), "ranges")


def with_range(rows: DataFrame, figures: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the other columns of figures, a row for each group and range (by, PART); null groups are one."""
    other = figures.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col(PART).alias("__of"), *[c for c in figures.columns if c not in (*by, PART)])
    same = F.col(PART) == F.col("__of")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{k}"))
    return rows.join(other, same).drop("__of", *[f"__by{k}" for k in range(len(by))])


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], scans: dict[str, Scan]) -> DataFrame:
    """df with a column for each scan over the rows of the same group, in order. Null groups are one."""
    rows, inside = dealt(df, by, order), W.partitionBy(*by, PART).orderBy(*order)
    numbered = rows.withColumn(ROW, F.row_number().over(inside)) if any(s.numbered for s in scans.values()) else rows.withColumn(ROW, F.lit(0))
    totals = numbered.groupBy(*by, PART).agg(*[s.total(F.col(ROW)).alias(f"__total_{n}") for n, s in scans.items()])
    before = W.partitionBy(*by).orderBy(PART)  # a group's ranges, as many as there are partitions at most
    offsets = totals.select(*by, PART, *[s.across(F.col(f"__total_{n}"), before).alias(f"__before_{n}") for n, s in scans.items()])
    own = rows.withColumns({f"__own_{n}": s.inside(inside) for n, s in scans.items()})
    return with_range(own, offsets, by).select(*df.columns, *[s.joined(F.col(f"__before_{n}"), F.col(f"__own_{n}")).alias(n) for n, s in scans.items()])


def sums_before(df: DataFrame, value: str, by: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """df with name: the sum of value over the rows of the same group that come before, 0 for the first."""
    return running(df, by, order, {name: sums(F.col(value))}).withColumn(name, F.col(name).cast("long"))
