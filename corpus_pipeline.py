"""Corpus pipeline, part of the llm package: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
and rereads what a stage returns before the next. All but the last return the
columns of documents.

1. toxicity: documents that the classifier rejects go. It is fitted on the
   labelled rows of the stage's own input.
2. near copies: of each component of the n-gram Jaccard join (five words, 0.8)
   the document with the smallest id stays. Documents without an id are in no
   component and stay, one for each text.
3. secrets: every span of the secret scan is replaced by its kind in brackets,
   and n_chars is counted anew. No document goes.
4. mixing: documents come as often as the mix of sources takes them.
5. encoding: token ids of every document, and digests of ids and decoded bytes.

A null text counts as empty; such documents stay until the mix, which takes
documents with words only. Documents without an id are rated, scanned and mixed
as others are. Repeated rows (equal id and text) become one in stage 2. An empty
table stays empty. Columns beyond those of documents, whatever their names, are
passed on as they are by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, ngram_join, secrets, toxicity
from millrace.llm.common import importable, remove, table, written_alone

#: Near copies share four fifths of their five-word shingles.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return ngram_join.first_of_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    clean = secrets.redact(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType))
    return clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return mixing.sampled_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Classifier, hashes and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
