"""SuperMinHash against the algorithm one element at a time, its variance, and groups against brute force."""

import random

import numpy as np
import pytest
from edges import ALL_IDS, edge, empty, ids

from millrace.llm import superminhash as S
from millrace.llm.shingles import mixed, shingle_sets

M = (1 << 64) - 1


def one_by_one(elements, places):
    """Each element through all steps: nothing is done at once, nothing stops early."""
    out = [M] * places
    for e in elements:
        order = list(range(places))
        for j in range(places):
            x = int(mixed(np.array([e], np.uint64) ^ mixed(np.array([(j + 1) * S._SEED & M], np.uint64)))[0])
            k = j + ((x & 0xFFFFFFFF) * (places - j) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j << S.FRACTION | x >> (64 - S.FRACTION))
    return out


@pytest.mark.parametrize("places", [1, 7, 96])
def test_same_as_one_by_one(places):
    r = random.Random(places)
    sets = [np.array(sorted({r.getrandbits(64) for _ in range(n)}), np.uint64) for n in (0, 1, 2, 5, 40, 300)]
    got = S.signatures(sets, places)
    assert got.tolist() == [one_by_one(s.tolist(), places) for s in sets]


def test_estimates_vary_less_than_independent_hashes():
    r = np.random.default_rng(6)
    places, errors = 96, []
    for _ in range(300):
        both, own = r.integers(0, 1 << 63, 12, np.uint64), r.integers(0, 1 << 63, 8, np.uint64)
        a, b = S.signatures([np.concatenate([both, own[:4]]), np.concatenate([both, own[4:]])], places)
        errors.append((a == b).mean() - 12 / 20)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.6 * 0.6 * 0.4 / places  # independent places have 0.6 * 0.4 / places


def brute(texts, words=S.WORDS, percent=S.PERCENT):
    sets = [set(s.tolist()) for s in shingle_sets([t or "" for t in texts], words)]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return [len(s) for s in sets], root


def edited(r, words, share):
    return [r.choice("xyzuvw") + str(r.random()) if r.random() < share else w for w in words]


def test_groups_same_as_brute_force(spark):
    r = random.Random(7)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(2000)}" for _ in range(r.randrange(6, 200))]
        texts += [" ".join(base)] * r.randrange(1, 3) + [" ".join(edited(r, base, s)) for s in (0.005, 0.01, 0.02, 0.03, 0.05)]
    passage = [f"p{k}" for k in range(60)]  # many documents share it
    texts += [" ".join(passage + [f"q{r.random()}" for _ in range(80)]) for _ in range(40)]
    texts += ["short text", "Short  text", "", None, "\t \n", "one two three four five", "one two three four five six"]
    r.shuffle(texts)
    got = {x.doc_id: x for x in S.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    sizes, root = brute(texts)
    assert [got[k].n_shingles for k in range(len(texts))] == sizes
    assert [got[k].component_id for k in range(len(texts))] == root
    assert all(got[k].kept == (k == root[k]) for k in range(len(texts)))


def test_a_large_group_of_near_copies(spark):
    r = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join([*base[:k], "odd", *base[k + 1 :]]) for k in range(120)] * 5 + [" ".join(edited(r, base, 0.5)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    got = S.near_duplicates(df).groupBy("component_id").count().collect()
    assert sorted(x["count"] for x in got) == [1] * 50 + [600]


def test_chance_of_a_miss():
    assert (1 - 0.85**S.BAND_ROWS) ** S.BANDS < 3e-8


def test_odd_rows(spark):
    got = S.near_duplicates(edge(spark)).collect()
    assert ids(got) == ALL_IDS
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 1 and not by[5].kept and by[1].kept
    assert all(by[k].n_shingles == 0 and by[k].component_id == k and by[k].kept for k in (2, 3, 4))
    assert by[8].n_shingles == 1 and by[None].component_id is None and by[None].kept is None
    none = S.near_duplicates(empty(spark))
    assert none.count() == 0 and none.columns == ["doc_id", "n_shingles", "component_id", "kept"]
