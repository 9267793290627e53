import random
import re

import numpy as np
import pytest
from edges import ALL_IDS, ROWS, edge, empty, ids

from millrace.llm import components, ngram_join, shingles


def plain_sets(rows, k):
    out = {}
    for key, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out[key] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


def plain_components(sets, percent):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def corpus(seed, n=260):
    """Chains of ever more edited copies, groups of equals, a passage that many share, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared, texts = [word() for _ in range(40)], []
    while len(texts) < n:
        base = [word() for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = shared
        for _ in range(rng.choice([1, 1, 2, 12])):
            texts.append(" ".join(base) if rng.random() < 0.7 else "\n".join(base).upper())
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = word()
    return list(enumerate(texts[:n], 5))


@pytest.mark.parametrize(("seed", "words", "percent", "few"), [(1, 4, 85, 0), (2, 5, 80, 1 << 17)])
def test_same_components_as_brute_force(spark, monkeypatch, seed, words, percent, few):
    for name, value in (("BLOCK", 20), ("FREQUENT", 6), ("FANOUT", 6), ("HOME_ROWS", 10), ("FEW_PAIRS", few)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, words=words, percent=percent).collect()}
    sets = plain_sets(rows, words)
    want = plain_components(sets, percent)
    assert len(set(want.values())) < len(rows)
    assert got == {k: (len(sets[k]), want[k]) for k in sets}


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(1)
    points = rng.poisson(1.0, (300, ngram_join.GROUPS)).astype(np.uint8)
    points[100:200] = points[:100]
    points[100:200, :3] += 1
    n, root = points.sum(1).astype(np.int64), np.arange(300)
    tree = ngram_join.Tree(points, n, root)
    for i in range(0, 300, 7):
        found, bound = tree.search(points[i], n[i], root[i], 85)
        overlap = np.minimum(points, points[i]).sum(1)
        want = (185 * overlap >= 85 * (n + n[i])) & (100 * np.minimum(n, n[i]) >= 85 * np.maximum(n, n[i])) & (root != i)
        assert set(np.flatnonzero(want)) <= set(found.tolist())
        assert (overlap[found] == bound).all()


def test_counts_beyond_a_byte():
    big = np.full(300, 7 << 20, np.uint64)
    packed = [ngram_join._point(big), ngram_join._point(big[:3])]
    points = ngram_join._points(packed)
    assert points[:, 7].tolist() == [300, 3]


def test_large_sets_have_more_groups_which_fold():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, n, np.uint64)) for n in (100, 9_000, 9_500)]
    packed = [ngram_join._point(s) for s in sets]
    assert [len(p) - 1 for p in packed] == [256, 2048, 2048]
    points = ngram_join._points(packed)
    assert points.sum(1).tolist() == [len(s) for s in sets]
    assert (points[1] == np.bincount((sets[1] >> np.uint64(20)).astype(int) & 255, minlength=256)).all()
    n = np.array([len(s) for s in sets])
    assert ngram_join._still_near(packed, n, np.array([1, 1, 0]), np.array([2, 1, 1]), 85).tolist() == [False, True, True]


def test_word_hashes_depend_on_words_alone():
    a = shingles.shingle_sets(["One two  three\tfour five", "x", "", " "], 4)
    b = shingles.shingle_sets(["zzz " * 50, "one TWO three four\nfive"], 4)
    assert (a[0] == b[1]).all() and [len(x) for x in a] == [2, 1, 0, 0]
    short = shingles.shingle_sets(["a b c", "a b", "b a", "c a b"], 4)
    assert len({int(s[0]) for s in short}) == 4


def test_edge_rows(spark):
    rows = ngram_join.jaccard_components(edge(spark)).collect()
    assert ids(rows) == ALL_IDS
    texts = {r[0]: r[1] for r in ROWS}
    sets = plain_sets(texts.items(), 4)
    for r in rows:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else 1 if r.doc_id == 5 else r.doc_id)
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    kept = ngram_join.first_of_each(edge(spark))
    assert kept.columns == edge(spark).columns and ids(kept.collect()) == [1, 2, 3, 4, 6, 7, 8, None]


def thue_morse(n):
    """Two words of 2**n letters whose hashes are equal under every polynomial modulo 2**64, for n >= 10."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_collide_under_polynomials_are_different(spark):
    a, b = thue_morse(10)
    assert len({int(s[0]) for s in shingles.shingle_sets([a, b], 4)}) == 2
    rows = [(1, a), (2, b), (3, f"{a} x y z {b}"), (4, f"{b} x y z {a}")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_word_hashes_tell_words_apart():
    """Words of all lengths that differ in one byte, in length alone or in the order of their letters."""
    rng = random.Random(2)
    words = {""}
    for n in [*range(1, 40), 63, 64, 65, 255, 256, 257, 600]:
        base = "".join(rng.choice("abc") for _ in range(n))
        words |= {base, base[::-1], base + "\0", base + "a", "a" * n, "\0" * n, "é" * n}
        words |= {base[:k] + "d" + base[k + 1 :] for k in range(0, n, 7)}
    words = sorted(words - {""})
    hashes, bounds = shingles.word_hashes(words)
    assert len(hashes) == len(words) == len(set(hashes.tolist())) and bounds.tolist() == list(range(len(words) + 1))
    together, _ = shingles.word_hashes([" \t".join(words).upper().replace("É", "é")])
    assert (together == hashes).all()


def test_lead_and_listing_keep_every_link():
    """Sets that link share a shingle listed by both that leads the smaller one."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        percent = int(rng.choice([80, 85]))
        both = rng.permutation(2_000)[: int(rng.integers(1, 90))]
        more = rng.permutation(np.arange(2_000, 4_000))
        k, m = rng.integers(0, 12, 2)
        x, y = np.sort(np.append(both, more[:k])), np.sort(np.append(both, more[50 : 50 + m]))
        if len(x) > len(y):
            x, y = y, x
        if 100 * len(both) >= percent * (len(both) + k + m):
            assert set(x[: ngram_join.leading(len(x), percent)]) & set(y[: ngram_join.listed(len(y), percent)])


def test_one_large_group_over_many_blocks(spark, monkeypatch):
    """Near copies of one text in a cell of many blocks, and a chain beside it."""
    for name, value in (("BLOCK", 16), ("HOME_ROWS", 12), ("FANOUT", 4)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(150):
        words = list(base)
        words[rng.randrange(80)] = f"own{k}"
        rows.append((k + 10, " ".join(words)))
    rows += [(k, " ".join(f"v{j}" for j in range(k, k + 60))) for k in range(5)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert got == plain_components(plain_sets(rows, 4), 85)


def test_rows_of_one_id_are_one_node(spark):
    """Documents 5 and 6 have several texts each, which connect those of others."""
    texts = {k: " ".join(f"{k}{j}" for j in range(30)) for k in "abcd"}
    rows = [(3, texts["a"]), (5, texts["a"]), (5, texts["b"]), (7, texts["b"]), (6, texts["b"]), (6, texts["c"]), (6, texts["c"]), (8, texts["c"]), (9, texts["d"]), (None, texts["d"]), (None, texts["a"])]
    got = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == {(k, 3) for k in (3, 5, 6, 7, 8)} | {(9, 9), (None, None)}


def test_long_chains_are_one_component(spark):
    rng = random.Random(1)
    names = rng.sample(range(10_000), 300)
    edges = [(a, b) for a, b in zip(names, names[1:], strict=False)] + [(3, 3), (20_001, 20_000), (20_000, 20_001)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: min(names) for k in names} | {20_000: 20_000, 20_001: 20_000}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
