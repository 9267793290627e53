"""Column functions on text: words, pre-tokens, n-grams, normalising, HTML, addresses, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\S+"
PIECE = r"\p{L}+|\d|[^\s\p{L}\d]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """array<string> of runs without white space."""
    return F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(WORD)).cast("long")


def pieces(text: Column | str) -> Column:
    """array<string> of words, single digits and runs of marks."""
    return F.regexp_extract_all(_col(text), F.lit(PIECE), F.lit(0))


def byte_values(text: Column | str) -> Column:
    """array<int> of the UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(_col(text), "UTF-8")), F.lit(".."), F.lit(0))
    return F.when(F.octet_length(_col(text)) > 0, F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def ngrams(tokens: Column, n: int) -> Column:
    """array<string> of the n-grams of a token array, with repeats; tokens are evaluated once."""

    def each(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, grams).otherwise(F.expr("cast(array() as array<string>)"))

    return F.transform(F.array(tokens), each)[0]


def normalize(text: Column | str) -> Column:
    """Lower case, white space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"\s+", " "))


def html_to_text(html: Column | str) -> Column:
    """Text without scripts, styles, comments and tags, the five named entities resolved."""
    c = F.regexp_replace(_col(html), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def html_title(html: Column | str) -> Column:
    return F.regexp_extract(_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)


def html_lang(html: Column | str) -> Column:
    return F.regexp_extract(_col(html), r"(?i)<html[^>]*\blang=\"([^\"]*)\"", 1)


def html_links(html: Column | str) -> Column:
    return F.regexp_extract_all(_col(html), F.lit(r"(?i)<a\s+href=\"([^\"]*)\""), F.lit(1))


def canonical_url(url: Column | str) -> Column:
    """host/path in lower case, without scheme, www. or m., query, fragment, last slash and .html."""
    c = F.lower(_col(url))
    for pattern in (r"^[a-z]+://", r"^(www|m)\.", r"[?#].*$", r"/+$", r"\.html$"):
        c = F.regexp_replace(c, pattern, "")
    return c


def hash_bucket(key: Column | str, buckets: int = 100) -> Column:
    """0 to buckets - 1 by the md5 of key as text, the same in every engine."""
    return F.conv(F.substring(F.md5(_col(key).cast("string")), 1, 8), 16, 10).cast("long") % buckets


def _boxed(text: Column) -> Column:
    """The content of the last \\boxed{..} whose braces close, however deep they nest; null if there is none.

    One fold over the text's braces: it keeps where it is, how deep, and of each
    box still open its depth and begin; a box that closes counts if it begins
    after the best one so far.
    """
    none = F.lit(-1)
    opened = F.expr("cast(array() as array<struct<depth: int, begin: int>>)")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), opened.alias("open"), none.alias("begin"), none.alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        box, shut = piece == r"\boxed{", piece == "}"
        after = acc["at"] + F.length(piece)
        depth = acc["depth"] + F.when(box | (piece == "{"), 1).when(shut, -1).otherwise(0)
        top = F.try_element_at(acc["open"], F.lit(-1))
        closes = F.coalesce(shut & (top["depth"] == acc["depth"]), F.lit(False))
        better = closes & (top["begin"] > acc["begin"])
        kept = F.when(box, F.concat(acc["open"], F.array(F.struct(depth.alias("depth"), after.alias("begin"))))).when(closes, F.slice(acc["open"], 1, F.size(acc["open"]) - 1)).otherwise(acc["open"])
        return F.struct(after.alias("at"), depth.alias("depth"), kept.alias("open"), F.when(better, top["begin"]).otherwise(acc["begin"]).alias("begin"), F.when(better, acc["at"]).otherwise(acc["end"]).alias("end"))

    pieces = F.regexp_extract_all(text, F.lit(r"\\boxed\{|[{}]|[^{}\\]+|\\"), F.lit(0))
    found = F.aggregate(pieces, start, step, lambda acc: F.when(acc["begin"] >= 0, F.substring(text, acc["begin"] + 1, acc["end"] - acc["begin"])))
    return F.when(F.contains(text, F.lit(r"\boxed{")), found)


def math_answer(text: Column | str) -> Column:
    """The last answer after ####, or else in \\boxed{..}, braces nested to any depth; thousands separators go. Null if there is none."""
    marked = F.regexp_extract_all(_col(text), F.lit(r"####\s*(-?[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?)"), F.lit(1))
    found = F.coalesce(F.try_element_at(marked, F.lit(-1)), _boxed(_col(text)))
    return F.regexp_replace(found, r"(?<=\d),(?=\d)", "")


def math_density(text: Column | str) -> Column:
    """Share of characters that are digits, operators or LaTeX commands' backslashes; 0 for none."""
    n = F.length(_col(text))
    marks = F.regexp_count(_col(text), F.lit(r"[0-9+*/=<>^\\]"))
    return F.when(n > 0, marks / n).otherwise(F.lit(0.0))
