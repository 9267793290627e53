"""Fitting on a bounded labelled sample and scoring all rows: what both tree classifiers share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, lean, spread, text_slices

#: Most labelled rows that a fit takes, by a hash of their id.
FIT_ROWS = 20_000

Features = Callable[[list[str]], np.ndarray]


def fit_sample(df: DataFrame, labels: DataFrame, label: str, text: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, y) of at most fit_rows labelled rows that aren't held out; null labels and texts don't count."""
    rows = labels.select(F.col(id_col).alias("id"), (F.col(label) > 0).cast("double").alias("y")).filter(~held_out("id") & F.col("y").isNotNull())
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    n = rows.count()
    if n > fit_rows:
        rows = rows.orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(fit_rows)
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return docs.join(F.broadcast(rows), "id").select("text", "y")  # at most fit_rows rows of two numbers


def fit_matrix(sample: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, in an order that depends on their values alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y")
            for i, j, texts in text_slices(b):
                x = features(texts)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), y.slice(i, j - i)], ["x", "y"])

    found = sample.mapInArrow(lean(run), "x array<double>, y double").toArrow()
    y = found["y"].to_numpy()
    if not len(y):
        return np.zeros((0, 1)), y
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort([*x.T[::-1], y])
    mixed = np.random.default_rng(7).permutation(len(y))
    return x[order][mixed], y[order][mixed]


def score_rows(df: DataFrame, features: Features, trees, cut: float, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    shared = df.sparkSession.sparkContext.broadcast((features, trees))  # a model, as large for any input
    slim = spread(df.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, trees = shared.value
        for b in batches:
            for i, j, texts in text_slices(b):
                score = np.clip(np.round(trees.score(features(texts)), 9), 0, 1)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("held_out").slice(i, j - i), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return slim.mapInArrow(lean(run), f"id {id_type}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def rows_below(df: DataFrame, features: Features, trees, cut: float, text: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, whose score is below cut."""
    shared = df.sparkSession.sparkContext.broadcast((features, trees))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, trees = shared.value
        for b in batches:
            for i, j, texts in text_slices(b, column=text):
                low = np.round(trees.score(features(texts)), 9) < cut
                if low.any():
                    yield b.slice(i, j - i).filter(pa.array(low))

    return df.mapInArrow(lean(run), df.schema)
