"""Operators on tables of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V


#: Bytes of query vectors that are sent to every task at once, about; for rows that _tile() doesn't take.
QUERY_BYTES = 16 << 20
#: Rows of base and queries that a task compares at once, queries of one matrix product, and pairs whose similarity is summed anew.
TILE, STEP, PAIRS = 1 << 14, 256, 1 << 16
#: What two similarities that round to the same six digits differ by at most, with room for the order of sums.
NEAR = 2e-6


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.chunked_array([c.flatten() for c in column.chunks], column.type.value_type)
    return flat.to_numpy().reshape(len(column), -1)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows in double precision, summed from the first component on as V.dot does."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x.astype(np.float64) * y.astype(np.float64)
    return total


def _tile(rows: pa.Table, queries: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, key, similarity) of every pair of the tile that can be among a query's k nearest, whichever way ties within NEAR fall.

    rows: (key, vector), queries: (query, vector), of one length and without nulls.
    Equal vectors are compared once; of their rows the first by key are enough,
    k besides those that have the query's own key.
    """
    ids = rows.column(0).to_numpy()
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], _matrix(rows.column(1))[by_id]
    enough = k + int(np.unique(ids, return_counts=True)[1].max())
    unlike, of = np.unique(vectors, axis=0, return_inverse=True)
    of = of.reshape(-1)
    member = np.argsort(of, kind="stable")  # rows by vector, then by key
    sizes = np.bincount(of)
    first = np.cumsum(sizes) - sizes
    sizes = np.minimum(sizes, enough)
    base = unlike.astype(np.float64)
    norms = np.sqrt(_in_order(unlike, unlike))
    scaled = (base / norms[:, None]).T
    own, asked = queries.column(0).to_numpy(), _matrix(queries.column(1))
    lengths = np.sqrt(_in_order(asked, asked))
    for at in range(0, len(own), STEP):
        near = (asked[at : at + STEP].astype(np.float64) / lengths[at : at + STEP, None]) @ scaled
        least = np.partition(near, -enough, axis=1)[:, -enough] if near.shape[1] > enough else np.full(len(near), -np.inf)
        q_at, v_at = np.nonzero(near >= least[:, None] - NEAR)
        for some in range(0, len(q_at), PAIRS):
            q, v = q_at[some : some + PAIRS] + at, v_at[some : some + PAIRS]
            similarity = _in_order(asked[q], unlike[v]) / (lengths[q] * norms[v])
            times = sizes[v]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            key, query = ids[member[np.repeat(first[v], times) + within]], np.repeat(own[q], times)
            other = key != query
            yield query[other], key[other], np.repeat(similarity, times)[other]


def _scored_in_tiles(queries: DataFrame, base: DataFrame, n: int, asked: int, k: int, key: str) -> DataFrame:
    """(query, key, similarity) for queries (query, _q) and base (key, vector), n and asked rows of them: each task gets a part of base and a block of the queries."""
    cores = base.sparkSession.sparkContext.defaultParallelism
    parts, blocks = max(-(-n // TILE), min(4 * cores, -(-n // 1024))), -(-asked // TILE)
    part, block = F.pmod(F.xxhash64(key), F.lit(parts)), F.pmod(F.xxhash64("query"), F.lit(blocks))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    a = base.withColumn("_part", part).withColumn("_block", every(blocks))
    b = queries.withColumn("_block", block).withColumn("_part", every(parts))
    kinds = dict(queries.dtypes)["query"], dict(base.dtypes)[key]

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        names = ["query", key, "similarity"]
        types = [own.schema.field(0).type, rows.schema.field(0).type, pa.float64()]
        found = list(_tile(rows, own, k)) if rows.num_rows and own.num_rows else []
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t) if found else pa.array([], t) for c, t in zip(zip(*found) if found else [()] * 3, types, strict=True)], names)

    return a.groupBy("_part", "_block").cogroup(b.groupBy("_part", "_block")).applyInArrow(run, f"query {kinds[0]}, `{key}` {kinds[1]}, similarity double")


def _known_dot(a: Column, b: Column) -> Column:
    """V.dot over the components that both have; null without any."""
    both = F.filter(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda s, x: s + x))


def _scored_by_rows(queries: DataFrame, base: DataFrame, key: str, vector: str) -> DataFrame:
    """The same for vectors of any kind, by Spark's functions; queries go to all tasks in blocks of QUERY_BYTES. Without a length, the similarity is not a number."""
    size = queries.agg(F.sum(8 * F.size("_q")).alias("bytes")).first()["bytes"] or 0
    blocks = -(-size // QUERY_BYTES) or 1
    own = F.pmod(F.xxhash64("query"), F.lit(blocks))
    pairs = reduce(DataFrame.unionByName, [base.join(F.broadcast(queries.filter(own == b)), F.col(key) != F.col("query")) for b in range(blocks)])
    a, b = F.col("_q"), F.col(vector)
    lengths = F.sqrt(_known_dot(a, a)) * F.sqrt(_known_dot(b, b))
    return pairs.select("query", key, F.when(lengths == 0, float("nan")).otherwise(_known_dot(a, b) / F.when(lengths != 0, lengths)).alias("similarity"))


def nearest(queries: DataFrame, base: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, similarity, rank): the k nearest of base for every row of a stated query set; exact.

    All pairs are compared, as products of matrices of TILE rows at most; a tile
    gives what can be among a query's k nearest, with similarities summed in
    order. Vectors with nulls, without a length or of another size than most go by rows.
    """
    q = queries.filter(F.col(key).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("_q"))
    rows = base.filter(F.col(key).isNotNull()).select(key, vector)
    dims = rows.agg(F.mode(F.size(vector)).alias("dims")).first()["dims"] or 0

    def plain(v: str) -> Column:
        finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
        return F.coalesce((F.size(v) == dims) & finite & (V.dot(F.col(v), F.col(v)) > 0), F.lit(False))

    n, odd = rows.agg(F.count_if(plain(vector)), F.count_if(~plain(vector))).first()
    asked, odd_asked = q.agg(F.count_if(plain("_q")), F.count_if(~plain("_q"))).first()
    scored = []
    if n and asked:
        scored.append(_scored_in_tiles(q.filter(plain("_q")), rows.filter(plain(vector)), n, asked, k, key))
    if odd or not scored:
        scored.append(_scored_by_rows(q, rows.filter(~plain(vector)), key, vector))
    if odd_asked:
        scored.append(_scored_by_rows(q.filter(~plain("_q")), rows.filter(plain(vector)), key, vector))
    scored = reduce(DataFrame.unionByName, scored).select("query", key, F.round("similarity", 6).alias("similarity"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), key))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def centroids(df: DataFrame, by: str = "label", vector: str = "embedding") -> DataFrame:
    """(by, pos, mean): the mean of each component by label."""
    each = df.select(by, F.posexplode(vector).alias("pos", "x"))
    return each.groupBy(by, "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
