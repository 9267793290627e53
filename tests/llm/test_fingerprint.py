import hashlib
import re

from edges import ALL_IDS, ROWS, edge, empty, ids
from pyspark.sql import functions as F

from millrace.llm import fingerprint as P


def rows_of(spark, pairs):
    return {r.doc_id: r for r in P.compare_with_next(spark.createDataFrame(pairs, "doc_id bigint, text string").repartition(3)).collect()}


def test_edits_and_order(spark):
    pairs = [(k * 7 % 101, f"w{k} " * (k % 9) + "é" * (k % 4)) for k in range(101)] + [(10**15, None), (-3, "x y")]
    for size in (P.RANGE_BYTES, 100, 1):
        P.RANGE_BYTES, before = size, P.RANGE_BYTES
        got = rows_of(spark, pairs)
        P.RANGE_BYTES = before
        order = sorted(((k, t or "") for k, t in pairs), reverse=True)
        assert len(got) == len(order)
        for i, (k, t) in enumerate(order):
            following, half = order[(i + 1) % len(order)][1], len(t) // 2
            assert got[k].n_chars == len(t)
            assert got[k].edited_sha256 == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()


def test_sketch_holds_all_hashes_below_the_threshold(spark):
    text = " ".join(f"w{k}" for k in range(3000))
    r = spark.createDataFrame([(text,)], "text string").select(P.sketch(F.col("text")).alias("s"), P.shingle_hashes(F.col("text")).alias("a")).first()
    assert r.s == sorted({h for h in r.a if h < (1 << P.BITS) // P.SCALE}) and len(r.a) == 2996
    assert 1_300 < len(r.s) < 1_700


def test_containment_of_unequal_documents(spark):
    words = [f"w{k}" for k in range(8000)]
    row = [(" ".join(words), " ".join(words[:1500]), " ".join(words[4000:4004]), "")]
    df = spark.createDataFrame(row, "a string, b string, c string, d string")
    a, b, d = (P.sketch(F.col(x)) for x in "abd")
    r = df.select(P.containment(a, b).alias("ab"), P.containment(a, a).alias("aa"), P.containment(a, d).alias("ad"), P.containment(d, d, F.lit(True)).alias("dd"), P.containment(P.merged(a, b), a).alias("m"), (P.sketch(F.concat_ws(" ", "a", "c")) == P.merged(a, P.sketch(F.concat_ws(" ", F.lit(" ".join(words[-4:])), "c")))).alias("union")).first()
    assert (r.ab, r.aa, r.ad, r.dd, r.m, r.union) == (1, 1, 0, 1, 1, True)


def plain_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_likeness_estimates_containment(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got, off = {r.doc_id: r for r in P.compare_with_next(docs).collect()}, {"edited": [], "next": []}
    for i, (key, text) in enumerate(rows):
        following, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        own = plain_shingles(text)
        for name, other in (("edited", plain_shingles(text[: len(text) - half] + following[:half])), ("next", plain_shingles(following))):
            off[name].append(abs(got[key][f"near_{name}"] - len(own & other) / min(len(own), len(other))))
    assert sum(off["edited"]) / len(rows) < 0.05 and sum(off["next"]) / len(rows) < 0.005


def test_ranges_are_even_however_ids_lie(spark):
    P.RANGE_BYTES, before = 4_000, P.RANGE_BYTES
    text = F.concat(F.lit("some words of a text "), F.col("id").cast("string"))
    base = spark.range(2_000).withColumn("text", text)
    try:
        for id_ in ("id", "cast(pow(1.015, id) as bigint)", "if(id < 700, 7, id * id)", "if(id < 700, null, id)", "if(id < 1900, id, id * 1000000000000)"):
            sizes = [r["count"] for r in P.in_ranges(base.selectExpr(f"{id_} as id", "text")).groupBy("range").count().collect()]
            assert len(sizes) > 6 and max(sizes) < 500, id_
    finally:
        P.RANGE_BYTES = before


def test_one_id_in_many_ranges(spark):
    """Documents of one id follow each other by hash of their texts, and the cycle takes in every row once."""
    P.RANGE_BYTES, before = 200, P.RANGE_BYTES
    rows = [(5 if k % 3 else k, f"text {k}") for k in range(300)] + [(None, f"none {k}") for k in range(100)]
    try:
        got = P._with_next(spark.createDataFrame(rows, "id bigint, text string"), "same", F.col("text")).collect()
    finally:
        P.RANGE_BYTES = before
    after = {(r.id, r.text): r.next_text for r in got}
    assert len(got) == len(rows) == len(after) and all(r.same == r.text and r.next_same == r.next_text for r in got)
    ids_of = {t: k for k, t in rows}
    order = [(ids_of[t], t) for t in after.values()]
    assert len(set(order)) == len(rows)
    steps = [(k, ids_of[t]) for (k, _), t in after.items()]
    assert sum(1 for a, b in steps if (b is not None) and (a is None or b > a)) == 1


def test_edge_rows(spark):
    rows = P.compare_with_next(edge(spark)).collect()
    assert ids(rows) == ALL_IDS
    by = {}
    for r in rows:
        by.setdefault({x[0]: x[1] or "" for x in ROWS}[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by.values())
    assert P.compare_with_next(empty(spark)).count() == 0


def test_short_texts_without_a_hash_are_not_alike(spark):
    """Of 64 two-word texts many have the empty fingerprint; only equal ones, and those without a word, are alike."""
    texts = [f"left{k} right{k}" for k in range(60)] + ["same words", "same words", "", " \t"]
    got = {r.doc_id: r for r in P.compare_with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert sum(not r.fingerprint for r in got.values()) > 20
    assert all(got[k].near_next == 0 for k in range(1, 60)) and all(got[k].near_edited == 0 for k in range(1, 60))
    assert got[61].near_next == 1 and got[63].near_next == 1 and got[62].near_next == 0
