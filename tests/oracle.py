"""Runs a query and its SQL side by side and compares columns, kinds of types and all values."""

from __future__ import annotations

import datetime
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x: object) -> object:
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, datetime.date) and not isinstance(x, datetime.datetime):
        return datetime.datetime(x.year, x.month, x.day)
    return x


KIND = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs; nothing if all is the same."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    theirs, types = found.fetchall(), dict(zip(names, [str(c[1]) for c in found.description], strict=True))
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    out = [f"type of {c}: {k}, {types[c]}" for c, k in df.dtypes if KIND.get(k, k) != types[c]]
    order = sorted(names)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    other = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in theirs)
    if mine != other:
        out.append(f"{sum(mine.values())} and {sum(other.values())} rows; only here {list((mine - other).items())[:2]}, only there {list((other - mine).items())[:2]}")
    return out
