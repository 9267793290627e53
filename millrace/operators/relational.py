"""Relational operators that Spark has no single call for.

Names that begin with two underscores are reserved for columns added inside; a
caller's columns of any other name pass through as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranges import PART, dealt, last_known, running, sums, sums_before, with_range


def _unlike(df: DataFrame, *names: str) -> None:
    """New columns don't replace any of the caller's."""
    if taken := set(names) & set(df.columns):
        raise ValueError(f"there is a column {', '.join(sorted(taken))} already")


def as_of_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], at: str, value: str, name: str) -> DataFrame:
    """left with the value of right's last row of the same key that isn't later; of several at one time the largest.

    Both sides are dealt by ranges of key and time, and each range goes on from
    the last value of the ranges before: a key may hold all rows. Null values of
    right are passed over; null keys and times match nothing.
    """
    _unlike(left, name)
    keys = [key] if isinstance(key, str) else list(key)
    by = [f"__k{i}" for i in range(len(keys))]
    keep = [c for c in left.columns if c not in (*keys, at)]
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.lit(1)
    sides = lambda df: [*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], F.col(at).alias("__t")]
    a = left.select(*sides(left), F.lit(1).alias("__side"), row.alias("__left"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    known = F.col(at).isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    b = right.filter(known).select(*sides(right), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.col(value).alias("__v"))
    unlike = F.xxhash64(*[F.col(f"__left.c{i}") for i, c in enumerate(keep) if "map" not in dict(left.dtypes)[c]]) if keep else F.lit(0)
    both = a.unionByName(b).withColumn("__tie", unlike)  # parts many rows of one key and time
    seen = running(both, by, ["__t", "__side", F.asc_nulls_first("__v"), "__tie"], {"__seen": last_known(F.col("__v"))}).filter("__side = 1")
    return seen.select(*[F.col(b).alias(k) for k, b in zip(keys, by, strict=True)], F.col("__t").alias(at), *[F.col(f"__left.c{i}").alias(c) for i, c in enumerate(keep)], F.col("__seen").alias(name))


#: The level of ranges without an end.
ENDLESS = 2000


def _level(low: str, high: str) -> Column:
    """The power of two that a range is no wider than; even ones only, which halves the levels in use."""
    width = F.col(high).cast("double") - F.col(low).cast("double")
    return F.when(width == float("inf"), ENDLESS).otherwise(2 * F.ceil(F.log2(width) / 2)).cast("int")


def _cell(value: Column, level: Column) -> Column:
    """The cell of a value: its multiple of two to the level, which no rounding moves."""
    return F.when(level == ENDLESS, F.lit(0).cast("long")).otherwise(F.floor(value.cast("double") / F.pow(F.lit(2.0), level)))


def _cells(low: str, high: str, level: Column) -> Column:
    """The one or two cells of a level that a range of that level or a lower one touches."""
    return F.array_distinct(F.array(_cell(F.col(low), level), _cell(F.col(high), level)))


def _levels(ranges: DataFrame, low: str, high: str) -> list[int]:
    """The levels in use: a thousand at most, since exponents of doubles are, whatever the rows."""
    return sorted(r[0] for r in ranges.filter(F.col(low) < F.col(high)).select(_level(low, high)).distinct().collect())


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Inner join on low <= value < high without an equal key.

    Each range is in the one or two cells of the level that fits its width, and
    a point is looked up once in each level in use: the rows that meet grow with
    the logarithm of the widths. Nulls, NaN and empty ranges match nothing.
    """
    levels = _levels(ranges, low, high)
    if not levels:
        return points.join(ranges, F.lit(False))
    p = points.filter(F.col(value).isNotNull()).withColumn("__level", F.explode(F.array(*map(F.lit, levels)))).withColumn("__cell", _cell(F.col(value), F.col("__level")))
    r = ranges.filter(F.col(low) < F.col(high)).withColumn("__level", _level(low, high)).withColumn("__cell", F.explode(_cells(low, high, F.col("__level"))))
    return p.join(r, ["__level", "__cell"]).filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__level", "__cell")


def overlap_join(left: DataFrame, right: DataFrame, low: str, high: str, other_low: str, other_high: str) -> DataFrame:
    """Inner join of half-open intervals that overlap: left's [low, high) and right's [other_low, other_high).

    Two intervals meet in the level of the wider one, where each touches one or
    two cells, and count in the cell of the later begin only. Nulls, NaN and
    empty intervals match nothing.
    """
    a = left.filter(F.col(low) < F.col(high)).withColumn("__own", _level(low, high))
    b = right.filter(F.col(other_low) < F.col(other_high)).withColumn("__other", _level(other_low, other_high))

    def home(df: DataFrame, ends: tuple[str, str], own: str) -> DataFrame:
        return df.withColumn("__level", F.col(own)).withColumn("__cell", F.explode(_cells(*ends, F.col(own))))

    def visits(df: DataFrame, ends: tuple[str, str], own: str, levels: list[int], equal: bool) -> DataFrame:
        up = F.filter(F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() as array<int>)"), lambda x: x >= F.col(own) if equal else x > F.col(own))
        return df.withColumn("__level", F.explode(up)).withColumn("__cell", F.explode(_cells(*ends, F.col("__level"))))

    mine, theirs = (low, high), (other_low, other_high)
    wide = home(a, mine, "__own").join(visits(b, theirs, "__other", _levels(left, *mine), True), ["__level", "__cell"])
    narrow = visits(a, mine, "__own", _levels(right, *theirs), False).join(home(b, theirs, "__other"), ["__level", "__cell"])
    both = wide.unionByName(narrow).filter((F.col(low) < F.col(other_high)) & (F.col(other_low) < F.col(high)))
    return both.filter(F.col("__cell") == _cell(F.greatest(low, other_low), F.col("__level"))).drop("__level", "__cell", "__own", "__other")


def overlap_totals(left: DataFrame, right: DataFrame, low: str, high: str, other_low: str, other_high: str, by: str, value: str, n: str = "n", total: str = "total") -> DataFrame:
    """(by, n, total) of the pairs with low < other_high and other_low < high: how many, and their sum of left's whole number `value`; left's low is below its high.

    No pair is made: of the intervals that begin before a row's end, those that
    end by its begin don't meet it. Both numbers are running sums over one order
    of all ends. Rows of right that end before they begin get back the intervals
    within that gap, which were taken off without having been counted. Nulls
    match nothing.
    """
    a = left.filter(F.col(low) < F.col(high)).select(F.col(low).alias("__low"), F.col(high).alias("__high"), F.col(value).cast("long").alias("__value"))
    b = right.filter(F.col(other_low).isNotNull() & F.col(other_high).isNotNull()).select(F.col(by).alias("__by"), F.col(other_low).alias("__begins"), F.col(other_high).alias("__ends"))
    key, none = b.schema["__by"].dataType, F.lit(0).cast("long")

    def ends(at: str, turn: int, *figures: tuple[str, ...]) -> DataFrame:
        """Left's begins or ends, a row for each; at one time, asked-for ends come before begins and ends before asked-for begins."""
        own = a.groupBy(F.col(at).alias("__at")).agg(F.count("*").alias("__c"), F.coalesce(F.sum("__value"), none).alias("__s"))
        return own.select("__at", F.lit(turn).alias("__turn"), none.alias("__tie"), F.lit(None).cast(key).alias("__by"), F.lit(0).alias("__sign"), *[(F.col(c) if c in ("__c", "__s") else none).alias(x) for x, c in figures])

    def asked(at: str, turn: int, sign: int) -> DataFrame:
        return b.select(F.col(at).alias("__at"), F.lit(turn).alias("__turn"), F.xxhash64("__by").alias("__tie"), "__by", F.lit(sign).alias("__sign"), *[none.alias(x) for x in names])

    names = ("__c1", "__s1", "__c2", "__s2")  # of begins, of ends
    rows = ends("__low", 1, *zip(names, ("__c", "__s", "", ""), strict=True)).unionByName(ends("__high", 0, *zip(names, ("", "", "__c", "__s"), strict=True)))
    rows = rows.unionByName(asked("__ends", 0, 1)).unionByName(asked("__begins", 1, -1))
    seen = running(rows, (), ["__at", "__turn", "__tie"], {f"{x}_before": sums(F.col(x)) for x in names}).filter("__sign != 0")
    pick = lambda x: F.when(F.col("__sign") == 1, F.col(f"__{x}1_before")).otherwise(-F.col(f"__{x}2_before"))
    parts = seen.select("__by", pick("c").alias("__n"), pick("s").alias("__total"))
    gaps = range_join(a, b, "__low", "__ends", "__begins").filter(F.col("__high") <= F.col("__begins")).select("__by", F.lit(1).cast("long").alias("__n"), F.coalesce("__value", none).alias("__total"))
    sums_ = parts.unionByName(gaps).groupBy("__by").agg(F.sum("__n").alias(n), F.sum("__total").alias(total))
    return sums_.filter(F.col(n) > 0).select(F.col("__by").alias(by), n, total)


def range_least(points: DataFrame, ranges: DataFrame, value: str, least: str, low: str, high: str, by: str, n: str = "n", name: str = "least") -> DataFrame:
    """(by, n, name) of the pairs with low <= value < high: how many, and their smallest `least`.

    No pair is made: the distinct values are numbered, a range is a stretch of
    numbers, and a stretch of any length is made of two cells of each power of two
    at most, whose least is known. Nulls, NaN and empty ranges match nothing.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    plain = lambda c: F.col(c).cast("double") + F.lit(0.0)  # noqa: E731  (one zero)
    p = points.filter(known(value)).groupBy(plain(value).alias("__at")).agg(F.count("*").alias("__c"), F.min(least).alias("__least"))
    r = ranges.filter((F.col(low) < F.col(high)) & known(low) & known(high)).select(F.col(by).alias("__by"), plain(low).alias("__low"), plain(high).alias("__high"))
    bounds, zero = r.select("__low", "__high").distinct(), F.lit(0).cast("long")
    rows = p.select("__at", F.lit(2).alias("__side"), zero.alias("__tie"), F.lit(None).cast("double").alias("__low"), F.lit(None).cast("double").alias("__high"), F.lit(1).cast("long").alias("__one"), "__c", "__least")
    nothing = F.lit(None).cast(p.schema["__least"].dataType).alias("__least")
    for side, c in enumerate(("__low", "__high")):  # before a point at the same value
        rows = rows.unionByName(bounds.select(F.col(c).alias("__at"), F.lit(side).alias("__side"), F.xxhash64("__low", "__high").alias("__tie"), "__low", "__high", zero.alias("__one"), zero.alias("__c"), nothing))
    seen = written(running(rows, (), ["__at", "__side", "__tie"], {"__place": sums(F.col("__one")), "__before": sums(F.col("__c"))}), "places")
    values = seen.filter("__side = 2").select("__place", "__least")
    m = values.count()
    top = max(m - 1, 0).bit_length()
    levels = F.array(*map(F.lit, range(top + 1)))
    cells = values.select("__place", "__least", F.explode(levels).alias("__level")).groupBy("__level", F.expr("shiftright(__place, __level)").alias("__cell")).agg(F.min("__least").alias("__least"))
    at = lambda side, c: F.max(F.when(F.col("__side") == side, F.col(c)))
    stretches = seen.filter("__side < 2").groupBy("__low", "__high").agg(at(0, "__place").alias("__a"), at(1, "__place").alias("__b"), (at(1, "__before") - at(0, "__before")).alias("__n")).filter("__n > 0")
    stretches = stretches.withColumn("__b", F.when(F.col("__b") == m, F.lit(1 << top)).otherwise(F.col("__b")))  # nothing comes after the last
    found = []
    for k in range(top + 1):
        a, b = F.expr(f"shiftright(__a + {(1 << k) - 1}, {k})"), F.expr(f"shiftright(__b, {k})")
        found += [F.when((a < b) & (a % 2 == 1), F.struct(F.lit(k).alias("level"), a.alias("cell"))), F.when((a < b) & (b % 2 == 1), F.struct(F.lit(k).alias("level"), (b - 1).alias("cell")))]
    asked = stretches.select("__low", "__high", "__n", F.explode(F.array_compact(F.array(*found))).alias("__x")).select("__low", "__high", "__n", F.col("__x.level").alias("__level"), F.col("__x.cell").alias("__cell"))
    leasts = asked.join(cells, ["__level", "__cell"]).groupBy("__low", "__high").agg(F.first("__n").alias("__n"), F.min("__least").alias("__least"))
    return r.join(leasts, ["__low", "__high"]).groupBy(F.col("__by").alias(by)).agg(F.sum("__n").alias(n), F.min("__least").alias(name))


def top_k(df: DataFrame, by: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank; Spark limits each group before the shuffle."""
    _unlike(df, name)
    return df.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col(name) <= k)


def sessions(df: DataFrame, by: str, at: str, gap_seconds: int, name: str = "session") -> DataFrame:
    """df with session, counted from 0 for each key: a new one begins after a gap of more than gap_seconds.

    Gaps are counted within ranges of key and time; a range goes on from the
    gaps of those before, and from the one between it and its neighbour. Rows
    without a time are in session 0.
    """
    _unlike(df, name)
    limit = gap_seconds * 1_000_000
    rows = dealt(df.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp"))), (by,), ["__at"])
    inside, before = W.partitionBy(by, PART).orderBy("__at"), W.partitionBy(by).orderBy(PART)
    new = F.when(F.col("__at") - F.lag("__at").over(inside) > limit, 1).otherwise(0)
    own = rows.withColumn("__new", new).withColumn("__own", F.sum("__new").over(inside.rangeBetween(W.unboundedPreceding, 0)))
    totals = own.groupBy(by, PART).agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.sum("__new").alias("__gaps"))
    edge = F.when(F.col("__first") - F.lag("__last").over(before) > limit, 1).otherwise(0)
    earlier = F.coalesce(F.sum("__gaps").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(by, PART, edge.alias("__edge"), earlier.alias("__earlier"))
    offsets = offsets.select(by, PART, (F.col("__earlier") + F.sum("__edge").over(before.rowsBetween(W.unboundedPreceding, 0))).alias("__before"))
    return with_range(own, offsets, (by,)).select(*df.columns, (F.col("__before") + F.col("__own")).cast("long").alias(name))


def ranks(df: DataFrame, by: Sequence[str], order: list[Column], tiles: int) -> DataFrame:
    """df with row_number, rank, dense_rank, percent_rank, cume_dist and ntile within its group.

    They follow from the rows and the distinct places of the ranges before and
    from the place within a range, so a group may hold all rows. Rows that are
    equal in the order are numbered as they come.
    """
    new = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
    _unlike(df, *new)
    rows, inside = dealt(df, by, order), W.partitionBy(*by, PART).orderBy(*order)
    own = rows.withColumns({"__row": F.row_number().over(inside), "__rank": F.rank().over(inside), "__dense": F.dense_rank().over(inside), "__upto": F.count("*").over(inside.rangeBetween(W.unboundedPreceding, 0))})
    totals = own.groupBy(*by, PART).agg(F.count("*").alias("__n"), F.max("__dense").alias("__kinds"))
    group = W.partitionBy(*by)
    before = group.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = totals.select(*by, PART, zero(F.sum("__n").over(before)).alias("__rows"), zero(F.sum("__kinds").over(before)).alias("__distinct"), F.sum("__n").over(group).alias("__all"))
    number, place, n = F.col("__rows") + F.col("__row"), F.col("__rows") + F.col("__rank"), F.col("__all")
    small = F.floor(n / tiles)
    larger = n - small * tiles  # the first tiles hold one row more
    tile = F.when(number <= larger * (small + 1), F.floor((number - 1) / (small + 1)) + 1).otherwise(larger + F.floor((number - 1 - larger * (small + 1)) / F.greatest(small, F.lit(1))) + 1)
    figures = (number, place, F.col("__distinct") + F.col("__dense"), F.when(n > 1, (place - 1) / (n - 1)).otherwise(0.0), (F.col("__rows") + F.col("__upto")) / n, tile)
    kinds = ("long", "long", "long", "double", "double", "long")
    return with_range(own, offsets, by).select(*df.columns, *[f.cast(k).alias(c) for f, k, c in zip(figures, kinds, new, strict=True)])


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, ..) exact percentiles of each group, interpolated, by selecting rows by rank.

    Equal values are counted first; running counts over ranges of the values
    then tell which of them hold the ranks asked for. No task keeps a group's
    values. A group without a value has nulls.
    """
    keys = [F.col(c).alias(f"__g{k}") for k, c in enumerate(by)]
    groups = [f"__g{k}" for k in range(len(by))]
    slim = df.select(*keys, F.col(value).cast("double").alias("__v"))
    counts = sums_before(slim.filter("__v is not null").groupBy(*groups, "__v").agg(F.count("*").alias("__c")), "__c", groups, ["__v"], "__first")
    sizes = slim.groupBy(*groups).agg(F.count("__v").alias("__n"))
    same = F.lit(True)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"{g}s"))
    both = sizes.select(*[F.col(g).alias(f"{g}s") for g in groups], "__n").join(counts, same, "left")
    picks = []
    for name, share in shares.items():
        rank = F.lit(share) * (F.col("__n") - 1)
        for side, at in (("low", F.floor(rank)), ("high", F.ceil(rank))):
            picks.append(F.max(F.when(F.col("__first") <= at, F.col("__v"))).alias(f"__{side}_{name}"))  # the largest value that begins at or before the rank
    picked = both.groupBy(*[f"{g}s" for g in groups], "__n").agg(*picks)
    out = [F.col(f"{g}s").alias(c) for g, c in zip(groups, by, strict=True)]
    for name, share in shares.items():
        rank = F.lit(share) * (F.col("__n") - 1)
        low, high = F.col(f"__low_{name}"), F.col(f"__high_{name}")
        out.append(F.when(low == high, low).otherwise((F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high).alias(name))
    return picked.select(*out)


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int) -> DataFrame:
    """Inner join for keys that a large share of left has: left is dealt to `salts` parts of each key, right repeated for each.

    Both sides are sorted: by the size of right's files Spark would send it to all
    tasks, and what a task then holds would grow with right and the salts.
    """
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b.hint("merge"), [on, "__salt"]).drop("__salt")


def places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with the place of each row in one order of all, from 1, without one task that sees them all."""
    _unlike(df, name)
    before = sums_before(df.withColumn("__one", F.lit(1)), "__one", (), order, name)
    return before.withColumn(name, F.col(name) + 1).drop("__one")
