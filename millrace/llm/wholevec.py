"""What the operators on embeddings share: rows whose vector is whole, as integers of a fixed scale."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components stay below this, so that they are longs without doubt.
MOST = 1 << 62


def _whole(v: Column) -> Column:
    """Whether a vector has components and all of them are numbers; an empty vector counts as none."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, number)


def scaled(df: DataFrame, vector: str, scale: int, **columns: str) -> DataFrame:
    """(columns.., x array<bigint>) of every row with a whole vector: floor(scale * component). columns: new name=old name."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(*[F.col(old).alias(new) for new, old in columns.items()], v.alias("_v")).filter(_whole(F.col("_v")))
    return rows.select(*columns, F.transform("_v", lambda x: F.floor(x * float(scale))).alias("x"))


class Shape(NamedTuple):
    rows: int
    dims: int
    most: int  # the largest magnitude


def shape(rows: DataFrame) -> Shape:
    """The rows, their one length and largest magnitude. Vectors of several lengths, or beyond MOST, are refused."""
    size, low, high = F.size("x"), F.array_min("x"), F.array_max("x")
    got = rows.agg(F.count("*"), F.min(size), F.max(size), F.min(low), F.max(high)).first()
    n, short, long, low, high = got
    if not n:
        return Shape(0, 0, 0)
    if short != long:
        raise ValueError(f"vectors have one length; these have {short} to {long}")
    if max(-low, high) >= MOST:
        raise ValueError("a component is too large for a long")
    return Shape(n, long, max(-low, high))


def element(most: int) -> str:
    """The smallest integer type that holds magnitudes up to `most`."""
    return "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """The vectors of an Arrow batch as rows of int64."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
