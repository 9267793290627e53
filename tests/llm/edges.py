"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

LONG = " ".join(f"word{k % 997} thing{k % 13}." for k in range(20_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n", "de", "b"),
    (5, "The quick brown fox jumps over the lazy dog, again and again.", "en", "b"),
    (5, "The quick brown fox jumps over the lazy dog, again and again.", "en", "b"),
    (6, LONG, "en", "a"),
    (7, "Füchse, größer als ñandú — 漢字 😀 don't we'll", "de", None),
    (8, "a", "de", "c"),
    (None, "no id here", "en", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
EMPTY = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def edge(spark, parts=3):
    """The rows with columns whose names operators use inside."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
    extra = "'x' as id, 1 as n, 2 as score, 'y' as k, 0 as size, 'z' as key, 1 as bucket, 'm' as media, 1 as h1, 2 as cell, 'q' as label"
    return df.selectExpr("*", *extra.split(", "))


def empty(spark):
    return spark.createDataFrame([], EMPTY)


def ids(rows, name="doc_id"):
    return sorted((r[name] for r in rows), key=lambda x: (x is None, x or 0))


ALL_IDS = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x or 0))
