"""Quality classifier: histogram gradient-boosted trees over statistics of the document.

Fitted on at most `fit_rows` labelled rows; scores are probabilities of label 1
and `predicted` is 1 from CUT on.

Defined cases: null and empty texts have all-zero statistics and get a score;
without labels of both kinds every score is the constant share of label 1 (0.5
for no labels at all); equal texts score equally; repeated ids in the labels
count once, as their largest label; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import gbdt
from .scoring import FIT_ROWS, fit_matrix, fit_sample, score_rows
from .textstats import DIGIT, LOWER, NEWLINE, OTHER, PUNCT, SPACE, SYMBOL, UPPER, class_counts

CUT = 0.3


def statistics(texts: list[str]) -> np.ndarray:
    """texts x figures: lengths, shares of character classes, repetition of words, bigrams and lines."""
    chars = class_counts(texts)
    n = np.maximum(chars.sum(1), 1)
    share = chars / n[:, None]
    out = np.zeros((len(texts), 14))
    for k, t in enumerate(texts):
        words = t.split()
        if not words:
            continue
        m = len(words)
        lines = [x for x in t.split("\n") if x]
        unlike = len(set(words))
        pairs = len(set(zip(words, words[1:], strict=False)))
        marked = sum(1 for w in words if not w[-1].isalnum())
        out[k] = (
            np.log1p(m),
            len(t) / m,
            unlike / m,
            pairs / max(m - 1, 1),
            unlike / m**0.5,
            len(set(lines)) / max(len(lines), 1),
            m / max(len(lines), 1),
            marked / m,
            t.count("!") / m,
            t.count("|") / m,
            t.count("...") / m,
            sum(map(str.isupper, words)) / m,
            max(map(len, words)),
            sum(1 for w in words if len(w) == 1) / m,
        )
    classes = share[:, [SPACE, LOWER, UPPER, DIGIT, PUNCT, SYMBOL, NEWLINE, OTHER]]
    return np.concatenate([out, classes], 1)


def fit(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> gbdt.Trees:
    x, y = fit_matrix(fit_sample(df, labels, label, text, id_col, fit_rows), statistics)
    return gbdt.fit(x, y)


def score(df: DataFrame, model: gbdt.Trees, text: str = "text", id_col: str = "doc_id", cut: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    return score_rows(df, statistics, model, cut, text, id_col)
