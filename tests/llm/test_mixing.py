import random
import re
from collections import Counter, defaultdict

from edges import ALL_IDS, ROWS, edge, empty, ids
from pyspark.sql import functions as F

from millrace.llm import mixing

KEYS = ["doc_id", "size", "source_size", "target", "taken"]


def reshared(sizes):
    """Targets by sharing the excess again and again, as the task words it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s] - 1e-9}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def corpus(spark, seed, sources):
    rng = random.Random(seed)
    rows = [(k, " ".join("w" for _ in range(rng.choice([0, 3, 40, 400]))), rng.choices(sources, [2 ** (i % 5) for i in range(len(sources))])[0]) for k in range(600)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_targets_are_met(spark):
    for seed, sources in ((1, ["b", "a", None, "é", "c", "Z"]), (2, ["one"]), (3, ["tiny", "big"])):
        rows, df = corpus(spark, seed, sources)
        sizes = defaultdict(int)
        for _, t, s in rows:
            sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
        want, of = reshared(sizes), {k: s for k, _, s in rows}
        got, taken = mixing.mix_documents(df).collect(), Counter()
        assert len(got) == len(rows)
        for r in got:
            s = of[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
            assert 0 <= r.taken <= 3 * r.size
            taken[s] += r.taken
        for s, t in want.items():
            assert abs(taken[s] - t) <= max(2, 0.02 * t), (s, t, taken[s])


def test_small_sources_meet_their_targets(spark):
    sizes = {"a": 3, "b": 40, "c": 129, "d": 700, "e": 5_000, "f": 60_000}
    rows = [(k * 100 + i, "w " * (n // 4 + (i < n % 4)), s) for k, (s, n) in enumerate(sizes.items()) for i in range(4)]
    of, got = {r[0]: r[2] for r in rows}, Counter()
    for r in mixing.mix_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect():
        got[of[r.doc_id]] += r.taken
    want = reshared(sizes)
    assert all(abs(got[s] - want[s]) <= max(2, 0.02 * want[s]) for s in sizes), (want, got)


def test_rows_of_one_id_are_placed_by_their_texts(spark):
    rows = [(1, t, "a") for t in ("x y z", "p q r", "k l m")] + [(2, "b " * 50, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    runs = [Counter(r.text for r in mixing.sampled_documents(df.repartition(n)).collect()) for n in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2]


def test_reruns_agree_and_blocks_repeat_only_after_all_others(spark):
    _, df = corpus(spark, 5, ["a", "b", "c"])
    a = sorted(map(tuple, mixing.mix_documents(df).select(KEYS).collect()))
    mixing.BUCKET_ROWS, before = 50, mixing.BUCKET_ROWS
    try:
        assert sorted(map(tuple, mixing.mix_documents(df.repartition(7)).select(KEYS).collect())) == sorted(map(tuple, mixing.mix_documents(df).select(KEYS).collect()))
    finally:
        mixing.BUCKET_ROWS = before
    assert a == sorted(map(tuple, mixing.mix_documents(df.repartition(2)).select(KEYS).collect()))
    from millrace.llm.common import written

    mix = mixing.plan(written(mixing.sized(df), "test-docs"), shard=16)
    quotas = {r.idx: r.quota for r in mix.sources.collect()}
    slots, blocks = mix.slots.collect(), {r.idx: r.blocks for r in mix.sources.collect()}
    assert Counter(r.idx for r in slots) == Counter(quotas) and len({r.slot for r in slots}) == len(slots)
    for idx, n in blocks.items():
        times = Counter(r.block for r in slots if r.idx == idx)
        assert max(times.values()) - min(times.get(b, 0) for b in range(n)) <= 1


def test_edge_rows(spark):
    rows = mixing.mix_documents(edge(spark)).collect()
    assert ids(rows) == ALL_IDS
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_documents(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, "", "a"), (1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert sorted(map(tuple, mixing.mix_documents(nothing).select(KEYS).collect())) == [(1, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_sampled_documents_come_as_often_as_taken(spark):
    df = edge(spark)
    out = mixing.sampled_documents(df)
    assert out.columns == df.columns
    most = Counter(r[0] for r in ROWS)
    got = Counter(r.doc_id for r in out.collect())
    assert all(n <= 3 * most[k] for k, n in got.items()) and not {2, 3, 4} & got.keys()
    assert mixing.sampled_documents(empty(spark)).count() == 0


def test_documents_without_an_id_are_spread_over_buckets(spark):
    """Nine tenths without an id: no bucket of a source holds more than its share."""
    rows = [(None if k % 10 else k, f"word{k} " * (k % 5 + 1), "s") for k in range(20_000)]
    docs = mixing.sized(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4))
    buckets = mixing._buckets(20_000)
    sizes = [r["count"] for r in docs.groupBy(F.pmod(mixing.hashed("doc", "id", "k"), F.lit(buckets))).count().collect()]
    assert len(sizes) == buckets and max(sizes) < 2 * 20_000 / buckets
