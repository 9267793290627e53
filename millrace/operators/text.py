"""Operators on text tables: vocabularies, statistics, deduplication of equals, splits, chat turns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import spread, written

SPECIAL = ("<unk>", "<eos>")
#: Most words of a vocabulary that is sent to every task; larger ones are joined.
MOST_TOKENS = 1 << 20
# Stop words that prose has (Rae et al. 2021).
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")


def build_vocab(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(id, token, n): the special tokens, then the `size` most frequent words by (-n, token)."""
    counts = df.select(F.explode(T.words(F.lower(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    ranked = top.select((F.row_number().over(W.orderBy(F.desc("n"), "token")) + len(SPECIAL) - 1).cast("long").alias("id"), "token", "n")  # `size` rows
    special = df.sparkSession.createDataFrame([(k, t, 0) for k, t in enumerate(SPECIAL)], "id bigint, token string, n bigint")
    return special.unionByName(ranked)


def encode_vocab(df: DataFrame, vocab: DataFrame, text: str = "text", key: str = "doc_id", most: int = MOST_TOKENS) -> DataFrame:
    """(key, ids array<bigint>): words to ids in order, 0 for unknown ones; a null text has none.

    A vocabulary of up to `most` words is looked up batch by batch where the
    texts are; nothing is shuffled. A larger one is joined: words are dealt by
    themselves, those that a large share of the texts has among several tasks,
    and ids go back to their text by position.
    """
    slim = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    known = vocab.select("token", "id")
    if known.limit(most + 1).count() > most:
        return _encoded_by_join(slim, known).withColumnRenamed("key", key)
    known = known.toArrow()  # `most` rows at most
    shared = df.sparkSession.sparkContext.broadcast((known["token"].combine_chunks(), known["id"].to_numpy()))
    none = F.expr("cast(array() as array<string>)")
    slim = slim.select("key", F.coalesce(T.words(F.lower("text")), none).alias("words"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids = shared.value
        for b in batches:
            words = b.column("words")
            at = pc.fill_null(pc.index_in(words.flatten(), value_set=tokens), -1).to_numpy()
            found = np.where(at < 0, 0, ids[at]) if len(ids) else np.zeros(len(at), np.int64)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(found))], ["key", "ids"])

    return slim.mapInArrow(run, f"key {dict(slim.dtypes)['key']}, ids array<bigint>").withColumnRenamed("key", key)


def _encoded_by_join(slim: DataFrame, known: DataFrame, salts: int = 64) -> DataFrame:
    """encode_vocab for any vocabulary: a text's distinct words meet the vocabulary, so that a word costs a row for each text, not for each time.

    Rows are numbered and written first, since equal rows are texts of their own.
    """
    none = F.expr("cast(array() as array<string>)")
    rows = written(slim.select(F.monotonically_increasing_id().alias("row"), "key", F.coalesce(T.words(F.lower("text")), none).alias("words")), "words")
    each = rows.select("row", F.explode(F.array_distinct("words")).alias("token")).withColumn("salt", F.pmod("row", F.lit(salts)))
    own = known.select("token", F.col("id").cast("long").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    found = each.join(own, ["token", "salt"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("ids"))  # a text's distinct words
    both = rows.join(found, "row", "left")
    return both.select("key", F.transform("words", lambda w: F.coalesce(F.try_element_at("ids", w), F.lit(0).cast("long"))).alias("ids"))


def token_stats(df: DataFrame, by: str = "lang", text: str = "text") -> DataFrame:
    """(by, n_docs, n_tok, p50, longest) of word counts."""
    n = df.select(by, T.word_count(text).alias("n"))
    return n.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tok"), F.percentile("n", F.lit(0.5)).alias("p50"), F.max("n").alias("longest"))


def text_profile(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ..): counts and ratios of words, letters, marks and repeated lines."""
    c = F.col(text)
    n, lines = T.word_count(text), F.filter(F.split(c, "\n"), lambda x: x != "")
    out = df.select(key, n.alias("n_words"), F.length(c).cast("long").alias("n_chars"), F.regexp_count(c, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(c, F.lit(r"[#$%&*|]")).alias("marks"), F.size(lines).alias("n_lines"), F.size(F.array_distinct(lines)).alias("n_unlike"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    return out.select(key, "n_words", "n_chars", ratio("letters", "n_chars").alias("letter_share"), ratio("marks", "n_words").alias("marks_per_word"), F.when(F.col("n_lines") > 0, F.round(1 - F.col("n_unlike") / F.col("n_lines"), 6)).otherwise(F.lit(0.0)).alias("repeated_lines"))


def text_repetition(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = 3) -> DataFrame:
    """(key, mean_word, stop_words, ended_lines, repeated_grams, top_gram) of every text.

    Mean word length, stop words, the share of lines that end as sentences do,
    the share of word n-grams that repeat an earlier one and that of the most
    frequent one. All are 0 for null and empty texts.
    """
    none = F.expr("cast(array() as array<string>)")
    empty = F.expr("cast(array() as array<bigint>)")
    whole = F.coalesce(F.col(text), F.lit(""))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))

    def runs(grams: Column) -> Column:
        """Sizes of the runs of equal neighbours, from where each begins."""
        begins = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: (i == 1) | (F.get(grams, i - 1) != F.get(grams, i - 2)))
        ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(grams) + 1))
        return F.when(F.size(grams) > 0, F.transform(F.zip_with(begins, ends, lambda a, b: b - a), lambda x: x.cast("bigint"))).otherwise(empty)

    def of_words(w: Column) -> Column:
        return F.struct(
            share(F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)), F.size(w)).alias("mean_word"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("stop_words"),
            F.transform(F.array(F.sort_array(T.ngrams(w, n))), lambda g: F.transform(F.array(runs(g)), lambda r: F.struct(share(F.size(g) - F.size(r), F.size(g)).alias("repeated"), share(F.coalesce(F.array_max(r), F.lit(0)), F.size(g)).alias("top")))[0])[0].alias("grams"),
        )

    def of_lines(lines: Column) -> Column:
        return share(F.size(F.filter(lines, lambda x: x.rlike('[.!?"]$'))), F.size(lines))

    lines = F.filter(F.split(whole, "\n"), lambda x: x != "")
    out = df.select(key, F.transform(F.array(F.coalesce(T.words(whole), none)), of_words)[0].alias("w"), F.transform(F.array(lines), of_lines)[0].alias("ended_lines"))
    return out.select(key, "w.mean_word", "w.stop_words", "ended_lines", F.col("w.grams.repeated").alias("repeated_grams"), F.col("w.grams.top").alias("top_gram"))


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(keep, copies): the smallest key of each normalised text; null texts are copies of each other."""
    return df.groupBy(F.md5(T.normalize(text)).alias("digest")).agg(F.min(key).alias("keep"), F.count("*").alias("copies")).select("keep", "copies")


def source_cap(df: DataFrame, k: int, by: str = "source", key: str = "doc_id") -> DataFrame:
    """The k rows of the smallest keys of each source."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(by).orderBy(key))).filter(F.col("__rank") <= k).drop("__rank")


def hash_split(df: DataFrame, valid_percent: int, key: str = "doc_id") -> DataFrame:
    """df with split: valid or train by a hash of the key."""
    return df.withColumn("split", F.when(T.hash_bucket(key) < valid_percent, "valid").otherwise("train"))


def hash_sample(df: DataFrame, share: float, key: str = "doc_id") -> DataFrame:
    """About `share` of the rows, the same in every run, by a hash of the key; rows of one key stay together, null keys go."""
    return df.filter(T.hash_bucket(key, 10_000) < round(share * 10_000))


def unicode_nfc(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text) in composed form; nulls stay."""
    slim = df.select(key, F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], [key, "text"])

    return slim.mapInArrow(run, slim.schema)


def chat_template(turns: DataFrame) -> DataFrame:
    """(conv_id, text): the turns of each conversation in order, as <role>text</role>."""
    turn = F.struct("turn", F.concat(F.lit("<"), "role", F.lit(">"), "text", F.lit("</"), "role", F.lit(">")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["t"]), "").alias("text"))


def loss_mask(turns: DataFrame) -> DataFrame:
    """(conv_id, mask array<int>): a number for each word of a conversation, 1 in the assistant's turns."""
    mask = F.array_repeat(F.when(F.col("role") == "assistant", 1).otherwise(0), T.word_count("text").cast("int"))
    return turns.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", mask.alias("m")))), lambda x: x["m"])).alias("mask"))


def turn_validation(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, contiguous, alternates, system_first) of every conversation."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "role", F.lag("role").over(w).alias("__before"))
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        (F.max("turn") == F.count("*") - 1).alias("contiguous"),
        F.bool_and(F.coalesce(F.col("__before") != F.col("role"), F.lit(True))).alias("alternates"),
        F.bool_and((F.col("role") != "system") | (F.col("turn") == 0)).alias("system_first"),
    )


def label_join(df: DataFrame, labels: DataFrame, by: str = "lang", key: str = "doc_id") -> DataFrame:
    """(by, n_docs, n_labelled, n_good): how far labels cover documents."""
    return df.select(key, by).join(labels, key, "left").groupBy(by).agg(F.count("*").alias("n_docs"), F.count("quality").alias("n_labelled"), F.count(F.when(F.col("quality") == 1, 1)).alias("n_good"))
