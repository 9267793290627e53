"""N-gram Jaccard join over count-vector R-trees.

Each distinct shingle set becomes a point: its shingles, hashed into GROUPS
groups, counted by group (more groups for large sets, which fold to fewer). No
two sets share more shingles than the sum over groups of the smaller count, and
the same holds for the largest counts of an R-tree node, so a query goes down
only to nodes that can still reach the overlap it needs. What survives is
verified on the sets themselves, made from the texts with a keyed 64-bit hash
for each word.

Points meet in cells, one R-tree for each; a cell of up to FANOUT points is a
tree of one leaf, and the leaves of many such cells are bounded together. A set
lists the first n - ceil(0.85 n) + 1 of its shingles in one order for all sets.
The first common shingle of two sets that link is listed by both, and with the
smaller set it is even among the first n - ceil(2 * 0.85 / 1.85 * n) + 1, its
lead. So each shingle that is in the lead of one set and listed by another is a
cell, and no link is lost. The order puts shingles that many sets list last,
which empties the cells of passages that many documents share.

Only connectivity is wanted, so it is found in rounds. First every point goes,
with its text, to its home, the cell of most points among its own; there all
pairs that pass the bound and aren't connected yet are verified at once. Homes
of more than HOME_ROWS points or HOME_SHINGLES shingles are cut into blocks by a
hash, twice and differently, so that blocks of one large group get connected.
Then all cells are gone through by counts alone, for pairs of different homes
and different components; those are verified by their texts. Of cells with more
than FANOUT points each point's best partner goes first. A cell of more than
BLOCK points is dealt to tasks as blocks of points outside its largest component
against blocks of all points, so that one group of copies costs no more than its
size.

Defined cases: null and empty texts and texts without a word have no shingle
and are linked with nothing; equal sets are one point; rows that share an id
are one node; a row without an id has no component; other columns are ignored.
Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, remove, spread, text_slices, written
from .components import components
from .shingles import shingle_sets

WORDS = 4
#: Sets link from this many hundredths on.
PERCENT = 85
GROUPS = 256
#: Most points of a cell, or of one side of a pair of its blocks, in a task.
BLOCK = 512
#: Most points, and shingles of their sets, that one task compares at home, about.
HOME_ROWS = 192
HOME_SHINGLES = 400_000
#: A shingle listed by more sets than this, or by more than one in a million of all listings, goes last.
FREQUENT = 48
FANOUT = 16
#: Pairs whose ids are broadcast to pick out the texts to verify; more are joined.
FEW_PAIRS = 1 << 17


def listed(n: int, percent: int = PERCENT) -> int:
    """How many shingles a set of n lists."""
    return n - -(-percent * n // 100) + 1 if n else 0


def leading(n: int, percent: int = PERCENT) -> int:
    """How many of these are its lead: the smaller of two sets that link has a common shingle there."""
    return n - -(-2 * percent * n // (100 + percent)) + 1 if n else 0


def _listing(shingles: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    p = listed(len(shingles), percent)
    if not len(frequent):
        return shingles[:p]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    late = frequent[at] == shingles
    return np.concatenate([shingles[~late], shingles[late]])[:p]


def _point(shingles: np.ndarray) -> bytes:
    """Counts by group, with a byte before them for their width; a power of two of groups, more for large sets."""
    groups = max(GROUPS, 1 << (max(len(shingles) // 8, 1) - 1).bit_length())
    counts = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups)
    return b"\1" + counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b"\4" + counts.astype(np.uint32).tobytes()


def _counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8 if packed[0] == 1 else np.uint32, offset=1)


def _folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The counts of fewer groups."""
    return counts if len(counts) == groups else counts.reshape(-1, groups).sum(0, dtype=np.uint32)


def _points(packed: list[bytes]) -> np.ndarray:
    """All in GROUPS groups."""
    if all(len(p) == GROUPS + 1 for p in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(-1, GROUPS + 1)[:, 1:]
    return np.stack([_folded(_counts(p), GROUPS).astype(np.uint32) for p in packed])


def _still_near(packed: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs pass the bound in as many groups as both points have."""
    ok = np.ones(len(i), bool)
    for k, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if len(packed[p]) > GROUPS + 1 < len(packed[q]):
            a, b = _counts(packed[p]), _counts(packed[q])
            groups = min(len(a), len(b))
            if groups > GROUPS:
                bound = int(np.minimum(_folded(a, groups), _folded(b, groups)).sum(dtype=np.int64))
                ok[k] = (100 + percent) * bound >= percent * (n[p] + n[q])
    return ok


def _shingled(df: DataFrame, words: int, percent: int, frequent=None) -> DataFrame:
    """(id, n, h1, h2, point, keys) of every row: the size of its set, a hash, its counts and its listing, the lead first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.zeros(0, np.uint64) if frequent is None else frequent.value
        for b in batches:
            for i, j, texts in text_slices(b):
                sets = shingle_sets(texts, words)
                both = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                keys = [_listing(s, late, percent) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                cols = [b.column("id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([_point(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "h1", "h2", "point", "keys"])

    return df.mapInArrow(lean(run), "id bigint, n bigint, h1 bigint, h2 bigint, point binary, keys array<bigint>")


class Tree:
    """Packed R-tree over count vectors; a node keeps the largest counts, the sizes and components it spans."""

    def __init__(self, points: np.ndarray, n: np.ndarray, root: np.ndarray) -> None:
        self.order = np.lexsort([*points.T[:8], n])
        points, n, root = points[self.order], n[self.order], root[self.order]
        self.levels = [(points, n, n, root, root)]
        while len(self.levels[-1][0]) > FANOUT:
            top, low, high, first, last = self.levels[-1]
            at = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def search(self, point: np.ndarray, n: int, root: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the points that may link with this one and are of another component, the bounds of their overlap)."""
        nodes = np.arange(len(self.levels[-1][0]))
        bound = np.zeros(0)
        for level, (top, low, high, first, last) in zip(range(len(self.levels) - 1, -1, -1), reversed(self.levels), strict=True):
            fits = (100 * low[nodes] * 1 <= n * 10000 // percent) & (100 * high[nodes] >= percent * n) & ((first[nodes] != root) | (last[nodes] != root))
            nodes = nodes[fits]
            bound = np.minimum(top[nodes], point).sum(1, dtype=np.int64)
            reach = (100 + percent) * bound >= percent * (n + low[nodes])
            nodes, bound = nodes[reach], bound[reach]
            if level:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
        return self.order[nodes], bound


def _may_meet(n, lead, home, i, j) -> np.ndarray:
    """Whether the pairs (i, j) have to be found in this cell: it is in the smaller one's lead, and they haven't met at home."""
    small = np.where(n[i] < n[j], lead[i], np.where(n[i] > n[j], lead[j], lead[i] | lead[j]))
    met = (home[i, 0] == home[j, 0]) & ((home[i, 1] == home[j, 1]) | (home[i, 2] == home[j, 2]))
    return small & ~met


def _cell_pairs(n, points, packed, root, side, lead, home, percent: int, best: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of members of one cell that pass the bound and may meet; best: one for each i at most."""
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(n)),) * 2
    if not len(left) or not len(right):
        return
    tree = Tree(points[right], n[right], root[right])
    for i in left.tolist():
        at, bound = tree.search(points[i], n[i], root[i], percent)
        found = right[at]
        here = _may_meet(n, lead, home, np.full(len(found), i), found)
        found, bound = found[here], bound[here]
        if best and len(found):
            k = (bound / (n[i] + n[found])).argmax()
            found, bound = found[k : k + 1], bound[k : k + 1]
        if len(found):
            ok = _still_near(packed, n, np.full(len(found), i), found, percent)
            yield np.full(int(ok.sum()), i), found[ok], (bound / (n[i] + n[found]))[ok]


def _at_home(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links of the sets that join components, enough to connect all that do link."""
    n = np.array([len(s) for s in sets])
    points = _points([_point(s) for s in sets])
    where = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(n)
    root, marked = np.arange(len(sets)), np.zeros(int(where.max()) + 1, np.int32)
    tree = Tree(points, n, root)
    for i in range(len(sets)):
        found = tree.search(points[i], n[i], -1, percent)[0]
        found = found[(found > i) & (root[found] != root[i])]
        if not len(found):
            continue
        own = where[ends[i] - n[i] : ends[i]]
        marked[own] = 1
        sizes = n[found]
        begins = np.cumsum(sizes) - sizes
        flat = np.arange(int(sizes.sum())) - np.repeat(begins, sizes) + np.repeat(ends[found] - sizes, sizes)
        both = np.add.reduceat(marked[where[flat]], begins)
        marked[own] = 0
        for j in found[100 * both >= percent * (n[i] + sizes - both)].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                yield i, j


def _home_links(dealt: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) from rows (home, block, id, text), each home's block in one run."""

    def links(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = list(_at_home(sets, percent)) if len(sets) > 1 else []
        a, b = ([ids[p[k]] for p in found] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for b in batches:
            keys = list(zip(b.column("home").to_pylist(), b.column("block").to_pylist(), strict=True))
            own = b.column("id").to_pylist()
            for i, j, texts in text_slices(b):
                for key, id_, s in zip(keys[i:j], own[i:j], shingle_sets(texts, words), strict=True):
                    if key != now:
                        yield links(ids, sets)
                        now, ids, sets = key, [], []
                    ids.append(id_)
                    sets.append(s)
        yield links(ids, sets)

    return dealt.mapInArrow(lean(run), "a bigint, b bigint")


def _pairs(members: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b, score), best: one for each a of a cell, from members (cell, x, y, side, lead, id, n, root, home, b0, b1, point), each cell's part together and sorted."""
    part = ("cell", "x", "y")

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables that end where a cell ends."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(c).to_numpy() for c in part]
            cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            if held:
                now, then = b.slice(0, 1).to_pylist()[0], held[-1].slice(held[-1].num_rows - 1).to_pylist()[0]
                if any(now[c] != then[c] for c in part):
                    yield pa.Table.from_batches(held)
                    held = []
            if len(cut):
                yield pa.Table.from_batches([*held, b.slice(0, int(cut[-1]))])
                held = [b.slice(int(cut[-1]))]
            else:
                held.append(b)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cells(batches):
            ids, n, root, side, lead = (t[c].to_numpy() for c in ("id", "n", "root", "side", "lead"))
            packed = t["point"].to_pylist()
            points, home = _points(packed), np.stack([t[c].to_numpy() for c in ("home", "b0", "b1")], 1)
            other = np.logical_or.reduce([k[1:] != k[:-1] for k in (t[c].to_numpy() for c in part)])
            starts = np.concatenate([[0], np.flatnonzero(other) + 1])
            sizes = np.diff(np.append(starts, len(ids)))
            which = np.repeat(np.arange(len(starts)), sizes)
            leaf = (sizes <= FANOUT)[which]
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for d in range(1, min(FANOUT, len(ids)) if not best else 1):  # cells that are one leaf: all of them at once, by the distance of their entries
                i = np.flatnonzero(leaf[:-d] & (which[:-d] == which[d:]) & (root[:-d] != root[d:]))
                i = i[(100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d])) & _may_meet(n, lead, home, i, i + d)]
                for k in range(0, len(i), 20_000):
                    some = i[k : k + 20_000]
                    bound = np.minimum(points[some], points[some + d]).sum(1, dtype=np.int64)
                    some = some[(100 + percent) * bound >= percent * (n[some] + n[some + d])]
                    some = some[_still_near(packed, n, some, some + d, percent)]
                    got.append((some, some + d, np.zeros(len(some))))
            for s, m in zip(starts.tolist(), sizes.tolist(), strict=True):
                if m > FANOUT or best:
                    e = s + m
                    for i, j, score in _cell_pairs(n[s:e], points[s:e], packed[s:e], root[s:e], side[s:e], lead[s:e], home[s:e], percent, best):
                        got.append((i + s, j + s, score))
            if got:
                i, j, score = (np.concatenate(c) for c in zip(*got, strict=True))
                a, b = (ids[i], ids[j]) if best else np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score if best else np.zeros(len(a)))], ["a", "b", "score"])

    return members.mapInArrow(lean(run), "a bigint, b bigint, score double")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table whose sets link, made from their texts (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for i, j, left in text_slices(t, column="p"):
                right = t.column("q").slice(i, j - i).to_pylist()
                for p, q in zip(shingle_sets(left, words), shingle_sets(right, words), strict=True):
                    both = len(np.intersect1d(p, q, True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
            kept = t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if kept.num_rows:
                yield kept

    if pairs.count() <= FEW_PAIRS:
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        texts = texts.join(F.broadcast(ids), "id", "left_semi")  # at most twice FEW_PAIRS ids
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("p")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("q")), "b")
    return both.select("a", "b", "p", "q").mapInArrow(lean(run), "a bigint, b bigint").distinct()


def _block(of: Column | str, seed: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(seed)), blocks).cast("int")


def _dealt(members: DataFrame, roots: DataFrame, points: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(members (cell, id, lead) of cells that hold several components and more than `least` points, with their points, each cell, or pair of its blocks, in one sorted run; a written table to remove afterwards).

    In cells of more than BLOCK points only those outside the largest component
    are on the left side; a pair of two of these meets twice.
    """
    rooted = members.drop("many").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    cells = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many")).filter(f"low <> high and many > {least}")
    cells = written(cells.select("cell", "many"), "cells")  # written, so that Spark can split a large cell's join
    mixed = written(rooted.join(cells, "cell"), "mixed")
    remove(cells)
    large, keys = mixed.filter(f"many > {BLOCK}"), ("cell", "id", "lead", "root")
    top = large.groupBy("cell", "root").agg(F.count("*").alias("c")).groupBy("cell").agg(F.max(F.struct("c", "root")).alias("top"))
    large = large.join(top, "cell").withColumn("rest", F.col("many") - F.col("top.c"))
    rights, lefts = (F.ceil(F.col(c) / BLOCK).cast("long") for c in ("many", "rest"))
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    spot = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(side).alias("side"))
    as_left = F.when(F.col("root") != F.col("top.root"), F.transform(each(rights), lambda y: spot(_block("id", "left", lefts), y, 0)))
    as_right = F.transform(each(lefts), lambda x: spot(x, _block("id", "right", rights), 1))
    large = large.select(*keys, F.inline(F.when(as_left.isNull(), as_right).otherwise(F.concat(as_left, as_right))))
    small = mixed.filter(f"many <= {BLOCK}").select(*keys, *[F.lit(0).alias(c) for c in ("x", "y", "side")])
    dealt = small.unionByName(large).join(points.drop("blocks"), "id").repartition("cell", "x", "y")
    return dealt.sortWithinPartitions("cell", "x", "y", "n", "id"), mixed


def _one_id(sized: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes of different sets that rows of one id have."""
    ends = [f(F.struct("h1", "h2")).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    several = sized.filter("n > 0").groupBy("id").agg(*ends).filter("low <> high").select("id")
    own = sized.join(several, "id", "left_semi").join(classes, ["h1", "h2"]).select("id", "rep")
    least = own.groupBy("id").agg(F.min("rep").alias("least"))
    return own.join(least, "id").filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))


def grouped(docs: DataFrame, shingled: DataFrame, classes: DataFrame, reps: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs (id, text): components of the links among points that share a cell.

    shingled (id, n, h1, h2, ..), classes (h1, h2, rep) and members (cell, id,
    lead, many) are written tables, which this removes; reps (id, n, point) are
    the points. Pairs of a cell that the lead of neither has are passed over.
    """
    # home: of a point's cells the one with most points
    homes = written(members.groupBy("id").agg(F.max(F.struct("many", "cell")).alias("h")).select("id", F.col("h.cell").alias("home")).join(reps.select("id", "n", "point"), "id"), "homes")
    sizes = homes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / HOME_ROWS), F.ceil(F.sum("n") / HOME_SHINGLES)).alias("blocks"))
    sizes = written(sizes.filter("blocks > 1"), "home-sizes")  # written, so that Spark can split a large home's join
    points = homes.join(sizes, "home", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumns({b: _block("id", b, F.col("blocks")) for b in ("b0", "b1")})
    points = written(points, "points")
    sized = written(shingled.select("id", "n", "h1", "h2"), "sized")
    remove(shingled, homes, sizes)
    texts = written(docs.filter("text is not null").join(points.select("id", "home", "blocks", "b0", "b1"), "id"), "texts")

    # first round: all pairs of one home and block; homes of several blocks are cut twice
    cut = F.when(F.col("blocks") > 1, F.array(F.col("b0"), -1 - F.col("b1"))).otherwise(F.array("b0"))
    dealt = texts.select("id", "text", "home", F.explode(cut).alias("block")).repartition("home", "block").sortWithinPartitions("home", "block", "id")
    links = written(_home_links(dealt, words, percent).unionByName(_one_id(sized, classes)), "links")
    roots = components(links)

    # second round: pairs of other homes that pass the bound, between different components of one cell;
    # in cells of more than a leaf each point's best partner goes first, so that few are left for all of them
    dealt, mixed = _dealt(members, roots, points, FANOUT)
    near = _pairs(dealt, percent, True)
    near = near.groupBy("a").agg(F.max(F.struct("score", "b")).alias("best")).select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()
    near = written(near, "near")
    stars = lambda roots: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = written(stars(roots).unionByName(_verified(near, texts, words, percent)), "links")
    remove(links, near, roots, mixed)
    roots = components(found)
    dealt, mixed = _dealt(members, roots, points, 1)
    rest = written(_pairs(dealt, percent, False).select("a", "b").distinct(), "rest")
    remove(members, points, mixed, found)
    more = written(stars(roots).unionByName(_verified(rest, texts, words, percent)), "links")
    remove(texts, rest, roots)
    roots = components(more)
    remove(more)

    out = sized.join(classes, ["h1", "h2"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id")).alias("component_id"))


def jaccard_components(df: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id that links lead to."""
    spark: SparkSession = df.sparkSession
    docs = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")))

    # shingles that many sets list; any order is exact, this one keeps cells small
    listings = _shingled(docs, words, percent).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c"))
    listings = written(listings.filter(F.col("c") > FREQUENT), "listings")
    total = listings.agg(F.sum("c")).first()[0] or 0
    often = listings.filter(F.col("c") > max(FREQUENT, total >> 20)).select("key").toArrow()["key"].to_numpy()  # at most 2**20
    frequent = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))
    remove(listings)

    shingled = written(_shingled(docs, words, percent, frequent), "shingled")
    classes = written(shingled.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep")), "classes")
    reps = shingled.join(classes.select("h1", "h2", F.col("rep").alias("id")), ["h1", "h2", "id"], "left_semi").dropDuplicates(["id", "h1", "h2"])
    lead = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent))  # the last place of it
    listed_by = reps.select("id", "n", F.posexplode("keys").alias("pos", "cell")).select("id", "cell", (F.col("pos") <= lead).alias("lead"))
    listed_by = written(listed_by, "listed")
    cells = listed_by.groupBy("cell").agg(F.count("*").alias("many"), F.bool_or("lead").alias("led")).filter("many > 1 and led")
    cells = written(cells.select("cell", "many"), "cells")
    members = written(listed_by.join(cells, "cell"), "members")
    remove(listed_by, cells)
    return grouped(docs, shingled, classes, reps, members, words, percent).withColumnRenamed("id", id_col)


def first_of_each(df: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of df whose id is the smallest of their component, one row for each id and text.

    Rows without an id are in no component and stay, one for each text.
    """
    key = "__id"
    keep = jaccard_components(df, text, id_col, words, percent).filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(key)).distinct()
    first = df.join(keep, F.col(id_col) == F.col(key), "left_semi").dropDuplicates([id_col, text])  # dealt by id already
    return first.unionByName(df.filter(F.col(id_col).isNull()).dropDuplicates([text])).select(df.columns)
