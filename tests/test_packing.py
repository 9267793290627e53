"""Packing against plain Python and its own invariants."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import packing

L = 64


def docs(spark, sizes):
    return spark.createDataFrame([(k, f"s{k % 2}", n) for k, n in enumerate(sizes)], "doc_id bigint, source string, n bigint")


def blocks_of(sizes):
    total = sum(sizes)
    return [min(L, total - at) for at in range(0, total, L)]


def plain_ffd(rows, length):
    bins, out = [], {}
    for n, key in sorted(((min(n, length), k) for k, n in rows), key=lambda r: (-r[0], r[1])):
        for b, used in enumerate(bins):
            if used + n <= length:
                break
        else:
            b = len(bins)
            bins.append(0)
        bins[b] += n
        out[key] = b
    return out


def test_ffd_is_first_fit(spark):
    sizes = [(k * 37) % 90 + 1 for k in range(120)]
    got = packing.pack_ffd(docs(spark, sizes), L).collect()
    for s in ("s0", "s1"):
        rows = [(k, n) for k, n in enumerate(sizes) if f"s{k % 2}" == s]
        assert {r.doc_id: r.bin for r in got if r.source == s and r.part == 0} == plain_ffd(rows, L)


def test_ffd_keeps_all_tokens_of_long_documents(spark):
    sizes = [(k * 53) % 200 + 1 for k in range(100)] + [L, L + 1, 2 * L, 20 * L + 3]
    got = packing.pack_ffd(docs(spark, sizes), L).toPandas()
    assert got.groupby("doc_id")["len"].sum().to_dict() == dict(enumerate(sizes))
    assert got.groupby(["source", "bin"])["len"].sum().max() <= L
    for key, rows in got.groupby("doc_id"):
        assert sorted(rows["part"]) == list(range(-(-sizes[key] // L)))
        if len(rows) > 1:
            bins = got[(got["source"] == rows["source"].iloc[0]) & got["bin"].isin(rows["bin"])]
            assert set(bins["doc_id"]) == {key} and len(bins) == bins["bin"].nunique()


def test_bfd_keeps_all_tokens_and_fits(spark):
    sizes = [(k * 53) % 200 + 1 for k in range(100)]
    got = packing.pack_bfd(docs(spark, sizes), L).toPandas()
    assert got["len"].sum() == sum(sizes)
    assert got.groupby(["source", "bin"])["len"].sum().max() <= L
    assert got.groupby("doc_id")["len"].sum().to_dict() == dict(enumerate(sizes))


def test_blocks_conserve_tokens(spark):
    for sizes in ([1], [L], [L - 1, 1], [L + 1], [1] * 200, [3 * L, 5, L]):
        df = docs(spark, sizes).withColumn("source", F.lit("s"))
        got = sorted((r.chunk, r.ntok) for r in packing.pack_spans(df, L).collect())
        assert [n for _, n in got] == blocks_of(sizes)
        assert sorted((r.chunk, r.ntok) for r in packing.pack_global(df, L).collect()) == got


def test_empty(spark):
    empty = docs(spark, [])
    for f in (packing.pack_spans, packing.segment_map, packing.pack_ffd, packing.pack_bfd, packing.pack_stats, packing.pack_global):
        assert f(empty, L).count() == 0


def bins_of(counts, fit):
    """{(len, rank): bin} that the stretches say."""
    found, bins = fit(sorted(counts.items(), reverse=True), L)
    out = {}
    for n, count in counts.items():
        own = [s for s in found if s[0] == n]
        for rank in range(count):
            _, first, bin_, per = [s for s in own if s[1] <= rank][-1]
            out[n, rank] = bin_ + (rank - first) // per
    return out, bins


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, L), st.integers(1, 30), min_size=1, max_size=12))
def test_stretches_of_lengths(counts):
    """First and best fit over histograms, against one document at a time."""
    rows = [((n, rank), n) for n, count in counts.items() for rank in range(count)]
    order = {key: k for k, (key, _) in enumerate(rows)}
    got, bins = bins_of(counts, packing.first_fit)
    want = plain_ffd([(order[key], n) for key, n in rows], L)
    assert {order[k]: b for k, b in got.items()} == want and bins == max(want.values()) + 1
    got, bins = bins_of(counts, packing.best_fit)
    want = {k: b for (k, _), b in plain_bfd([(order[key], n) for key, n in rows], L).items()}
    assert {order[k]: b for k, b in got.items()} == want and bins == max(want.values()) + 1


def test_a_task_sees_lengths_not_documents(spark):
    """One shard with all documents: what is gathered by shard is its histogram, and places are found by ranges."""
    n, sizes = 20_000, 64
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % sizes + 1).alias("n"))
    for f, fit in ((packing.pack_ffd, packing.first_fit), (packing.pack_bfd, packing.best_fit)):
        got = f(df, L)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Pandas" not in plan and "Python" not in plan
        assert got.groupBy("bin").agg(F.sum("len").alias("s")).agg(F.max("s")).first()[0] <= L and got.count() == n
        def counted(counts, length, fit=fit, most=L):
            assert len(counts) <= most  # a row for each length
            return fit(counts, length)

        assert packing._stretches(df.select(F.col("source").alias("_s"), F.col("n").alias("len")), L, counted).count() > 1


def plain_bfd(rows, length):
    """Each piece, longest first, to the bin with the least room that takes it; of equals the first."""
    rooms, out = [], {}
    for n, key, part in sorted(((min(length, n - at), key, at // length) for key, n in rows for at in range(0, n, length)), key=lambda r: (-r[0], r[1], r[2])):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= n]
        b = min(fits)[1] if fits else len(rooms)
        rooms += [length] * (b == len(rooms))
        rooms[b] -= n
        out[key, part] = b
    return out


def test_bfd_is_best_fit(spark):
    sizes = [(k * 41) % 150 + 1 for k in range(160)]
    got = packing.pack_bfd(docs(spark, sizes), L).collect()
    for s in ("s0", "s1"):
        rows = [(k, n) for k, n in enumerate(sizes) if f"s{k % 2}" == s]
        assert {(r.doc_id, r.part): r.bin for r in got if r.source == s} == plain_bfd(rows, L)


ROWS = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (2, "c", None), (None, "d e f", "x"), (4, "one two three four five six seven", "x"), (2, "zz", "x"), (2, "yy", "x"), (9, "k", None)]


def odd(spark, parts=3):
    """Nulls, repeats, ties and columns whose names are used inside."""
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").repartition(parts)
    return df.selectExpr("*", "7 as begin", "'q' as chunk", "1 as _s", "2 as _o", "3 as _t", "4 as pos", "5 as part")


def plain_tokens():
    """Tokens by shard, documents by key (null first) and length; documents of one key and length in any order."""
    out = {}
    for shard in {r[2] for r in ROWS}:
        rows = sorted((r for r in ROWS if r[2] == shard), key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").split())))
        out[shard] = [t for r in rows for t in [*(r[1] or "").split(), "<eos>"]]
    return out


def test_nulls_repeats_and_ties(spark):
    want = plain_tokens()
    for length in (3, 5, 100):
        runs = []
        for parts in (1, 4):
            df = odd(spark, parts)
            tokens = packing.pack_tokens(df, length).collect()
            runs.append(sorted((str(r.source), r.chunk, r.n, tuple(r.tokens)) for r in tokens))
            for shard, all_ in want.items():
                got = [t for r in sorted((r for r in tokens if r.source == shard), key=lambda r: r.chunk) for t in r.tokens]
                assert sorted(got) == sorted(all_) and [t == "<eos>" for t in got] == [t == "<eos>" for t in all_]
            n = packing.lengths(df)
            spans = packing.spans(n, length).collect()
            assert sum(r.len for r in spans) == sum(map(len, want.values()))
            blocks = {(r.source, r.chunk): r.ntok for r in packing.pack_spans(n, length).collect()}
            assert blocks == {(r.source, r.chunk): r.n for r in tokens}
            assert sum(r.ntok for r in packing.pack_global(n, length).collect()) == sum(blocks.values())
            stats = {r.source: (r.n_tok, r.n_seq) for r in packing.pack_stats(n, length).collect()}
            assert stats == {s: (len(t), -(-len(t) // length)) for s, t in want.items()}
            assert len(packing.segment_map(n, length).collect()) == len(spans)
            for f in (packing.pack_ffd, packing.pack_bfd):
                assert sum(r.len for r in f(n, length).collect()) == sum(blocks.values())
        assert runs[0] == runs[1]
    assert {r.kept for r in packing.pad_truncate(odd(spark), 6).filter("doc_id = 2").collect()} == {1, 2}


def test_two_equal_rows_are_two_documents(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x")], "doc_id bigint, text string, source string")
    assert [(r.n, r.tokens) for r in packing.pack_tokens(df, 100).collect()] == [(6, ["a", "b", "<eos>"] * 2)]


def test_no_window_over_a_whole_shard(spark):
    """Rows are summed within ranges; what is summed by shard alone are the ranges' totals."""
    df = docs(spark, [5, 6, 7])
    for f in (packing.pack_spans, packing.pack_stats, packing.pack_global):
        plan = f(df, L)._jdf.queryExecution().optimizedPlan().toString()
        windows = [line.split("], ", 1)[1] for line in plan.splitlines() if "Window [" in line]
        assert len(windows) == 2 and all("_part#" in w for w in windows), windows  # by range, or over ranges
        assert "CartesianProduct" not in plan
