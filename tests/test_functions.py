"""Column functions on edge rows, and sources."""

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import text as X
from millrace.sources import tables


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f("t").alias("x")).first().x


def test_math_answers(spark):
    cases = {
        "so #### 1,234": "1234",
        r"thus \boxed{\frac{1}{2}}": r"\frac{1}{2}",
        r"\boxed{3} then #### 4 then #### -5.5": "-5.5",
        r"\boxed{\frac{\sqrt{x^{2}}}{\sqrt{1,234}}}": r"\frac{\sqrt{x^{2}}}{\sqrt{1234}}",
        r"\boxed{a\boxed{b}c}": "b",
        r"\boxed{1} and \boxed{never {closed}": "1",
        r"\boxed{}": "",
        r"\boxed{": None,
        "none": None,
        "": None,
        None: None,
    }
    for t, expected in cases.items():
        assert one(spark, t, T.math_answer) == expected


def test_math_density(spark):
    assert one(spark, "", T.math_density) == 0
    assert one(spark, "1+1=", T.math_density) == 1
    assert one(spark, None, T.math_density) == 0


def test_words_and_bytes(spark):
    assert one(spark, "  a\tbé  ", T.words) == ["a", "bé"]
    assert one(spark, "", T.words) == []
    assert one(spark, "é", T.byte_values) == [0xC3, 0xA9]
    assert one(spark, "", T.byte_values) == []
    assert one(spark, "ab12!?", T.pieces) == ["ab", "1", "2", "!?"]


def test_ngrams(spark):
    grams = lambda c: T.ngrams(T.words(c), 2)
    assert one(spark, "a b c", grams) == ["a b", "b c"]
    assert one(spark, "a", grams) == []


def test_nfc(spark):
    df = spark.createDataFrame([(1, "é"), (2, None), (3, "a")], "doc_id int, text string")
    assert [r.text for r in X.unicode_nfc(df).orderBy("doc_id").collect()] == ["é", None, "a"]


def test_vocab_keeps_order_and_empty_rows(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "zz")], "doc_id int, text string")
    vocab = X.build_vocab(df.filter("doc_id = 1"), 10)
    ids = {r.doc_id: r.ids for r in X.encode_vocab(df, vocab).collect()}
    assert ids == {1: [2, 3, 2], 2: [], 3: [], 4: [0]}


def test_formats_round_trip(spark, tmp_path):
    df = spark.range(20).withColumn("part", F.col("id") % 3).withColumn("name", F.concat(F.lit("n"), "id"))
    for fmt in ("parquet", "orc", "json", "csv"):
        tables.write(df, str(tmp_path / fmt), fmt, by=("part",))
        schema = "id bigint, name string, part bigint" if fmt in ("json", "csv") else None
        back = tables.read(spark, str(tmp_path / fmt), fmt, schema).select("id", F.col("part").cast("bigint"), "name")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    tables.write(df.select("name"), str(tmp_path / "text"), "text")
    assert tables.read(spark, str(tmp_path / "text"), "text").count() == 20


def test_repetition_of_odd_texts(spark):
    rows = [(1, "a b c a b c a b c"), (2, None), (3, ""), (4, "The end.\nno end\n\nwhy?"), (5, "one two")]
    got = {r.doc_id: r for r in X.text_repetition(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert (got[1].repeated_grams, got[1].top_gram, got[1].mean_word) == (round(4 / 7, 6), round(3 / 7, 6), 1.0)
    assert all(tuple(got[k])[1:] == (0.0, 0, 0.0, 0.0, 0.0) for k in (2, 3))
    assert (got[4].ended_lines, got[4].stop_words) == (round(2 / 3, 6), 1) and got[5].repeated_grams == 0


def test_hash_sample_is_a_share(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    n = X.hash_sample(df, 0.25).count()
    assert abs(n - 5_000) < 4 * (20_000 * 0.25 * 0.75) ** 0.5
    assert X.hash_sample(spark.createDataFrame([(None,), (1,)], "doc_id bigint"), 1.0).count() == 1


def test_nearest_in_blocks_is_nearest(spark, monkeypatch):
    from millrace.operators import vectors

    e = spark.createDataFrame([(k, [float((k * p) % 17 - 8) for p in (1, 3, 5)]) for k in range(60)], "vec_id bigint, embedding array<float>")
    q = e.filter("vec_id < 9")
    whole = sorted(map(tuple, vectors.nearest(q, e, 4).collect()))
    monkeypatch.setattr(vectors, "QUERY_BYTES", 50)
    assert sorted(map(tuple, vectors.nearest(q, e, 4).collect())) == whole


def test_scratch_tables_can_be_cleaned_up(spark):
    from pathlib import Path

    from millrace.sources import scratch

    folder = Path(scratch.shared_dir(spark).removeprefix("file://"))
    t = scratch.written(spark.range(5), "kept")
    u = scratch.written(t.groupBy("id").count(), "more")
    assert t.count() == u.count() == 5 and folder.joinpath(t.written_to.rsplit("/", 1)[1]).is_dir()
    scratch.remove(t)
    assert not folder.joinpath(t.written_to.rsplit("/", 1)[1]).exists() and u.count() == 5
    assert spark.conf.get(scratch.CLEANUP, "false") == "false"


def test_many_boxes_in_one_pass(spark):
    """Open, closed and nested boxes by the thousand: the last that begins and closes."""
    text = r"\boxed{" * 300 + "".join(rf"\boxed{{a{{{k}}}}} }} " for k in range(2000)) + r"\boxed{open"
    assert one(spark, text, T.math_answer) == "a{1999}"
    assert one(spark, r"a } \boxed{x} } \boxed{y{z}\frac{1}{2}} \boxed{", T.math_answer) == r"y{z}\frac{1}{2}"


def test_vocabularies_of_any_size(spark):
    rows = [(1, "the cat the dog"), (1, "the cat the dog"), (2, None), (3, ""), (None, "unknown cat"), (4, "the " * 500 + "end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    vocab = spark.createDataFrame([(2, "the"), (3, "cat"), (4, "dog"), (5, "end")], "id bigint, token string")
    small, large = (sorted((r.doc_id or 0, r.ids) for r in X.encode_vocab(df, vocab, most=m).collect()) for m in (10, 3))
    assert small == large and small[1] == (1, [2, 3, 2, 4]) and len(small) == 6


def test_callers_columns_stay(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 8)], "source string, doc_id int, _rank int")
    assert [r._rank for r in X.source_cap(df, 1).collect()] == [9]
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", "ho", "y")], "conv_id int, turn int, role string, text string, before string")
    assert [r.alternates for r in X.turn_validation(turns).collect()] == [True]
