"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features: densities of lexicon words, nearness of second-person words to
them, rates of capitals, punctuation and obfuscated words. The lexicon is a
short fixed list together with the words and word beginnings that the labelled
sample sets apart (a log-odds score with a floor on its z value). The calibration
is cross-fitted throughout: equal texts are in one of FOLDS folds, and what is
said of a fold comes from a lexicon and trees that saw no label of it.

Defined cases: null and empty texts have all-zero features and get a score;
labels of one kind give a constant; equal texts score equally; repeated ids in
the labels count once, as their largest label; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import lean, remove, text_slices, written
from .scoring import FIT_ROWS, fit_matrix, fit_sample, rows_below, score_rows
from .textstats import DIGIT, NEWLINE, PUNCT, SYMBOL, UPPER, class_counts

CUT = 0.5
#: Most words, and most word beginnings, in a learned lexicon.
LEXICON = 3_000
STEM = 5
#: A second-person word this many words away or fewer is near.
NEAR = 4
#: Folds of the calibration, by a hash of the text.
FOLDS = 3

# Insults and second-person words of four languages.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown pig fool dummkopf idioten arschloch trottel imbécile imbécil idiota estúpido estúpida basura connard crétin salaud".split())
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro".split())

_word = re.compile(r"[^\W_]+(?:[@$!1|*.\-_][^\W_]+)*|[^\W_]+")
#: What stands for letters in obfuscated words.
_plain = str.maketrans({"@": "a", "$": "s", "!": "i", "1": "i", "|": "i", "0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "*": None, ".": None, "-": None, "_": None})


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


@dataclass(frozen=True)
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]

    def features(self, texts: list[str]) -> np.ndarray:
        chars = class_counts(texts)
        n = np.maximum(chars.sum(1), 1)
        out = np.zeros((len(texts), 15))
        word, stem = self.words.get, self.stems.get
        for k, t in enumerate(texts):
            words = words_of(t)
            m = len(words)
            if not m:
                continue
            weights, hits, fixed, odd, odd_hits = [], [], 0, 0, 0
            for i, w in enumerate(words):
                if not w.isalpha():
                    odd += 1
                    if (p := w.translate(_plain)) in INSULTS or p in self.words:
                        odd_hits += 1
                        w = p
                x = word(w)
                if x is not None:
                    weights.append(x)
                    hits.append(i)
                if w in INSULTS:
                    fixed += 1
                    if x is None:
                        hits.append(i)
            stems = [x for x in [stem(w[:STEM]) for w in words] if x is not None]
            second = [i for i, w in enumerate(words) if w in SECOND]
            near = 0
            if hits and second:
                a, b = np.array(hits), np.array(second)
                at = np.searchsorted(b, a)
                near = int((np.minimum(np.abs(a - b[np.minimum(at, len(b) - 1)]), np.abs(a - b[np.maximum(at - 1, 0)])) <= NEAR).sum())
            out[k] = (
                np.log1p(m), len(weights), len(weights) / m, sum(weights) / m, max(weights, default=0.0), fixed, fixed / m,
                len(stems), len(stems) / m, max(stems, default=0.0), near / m, len(second) / m, odd / m, odd_hits / m, len({words[i] for i in hits}),
            )
        more = np.stack([chars[:, UPPER] / n, (chars[:, PUNCT] + chars[:, SYMBOL]) / n, chars[:, SYMBOL] / n, chars[:, DIGIT] / n, chars[:, NEWLINE] / n, np.array([t.count("!") for t in texts]) / n], 1)
        return np.concatenate([out, more], 1)


def fold_of(text: str) -> int:
    return crc32(text.encode()) % FOLDS


def learn_lexicons(sample: DataFrame, size: int = LEXICON) -> list[Lexicon]:
    """Words and beginnings of words whose documents are toxic far more often than others: of all of the sample, then without each fold."""
    kinds = [f"{y}{f}" for f in range(FOLDS) for y in "tc"]  # toxic and clean documents of each fold

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: Counter() for k in kinds}
        for b in batches:
            labels = b.column("y").to_pylist()
            pairs = ((t, y) for i, j, texts in text_slices(b) for t, y in zip(texts, labels[i:j], strict=True))
            for t, y in pairs:
                words, own = set(words_of(t)), counts[f"{'t' if y else 'c'}{fold_of(t)}"]
                own.update(words)
                own.update({f"\0{w[:STEM]}" for w in words if len(w) >= STEM})
                own.update(("",))  # documents
        keys = list(set().union(*counts.values()))
        for i in range(0, len(keys), 10_000):
            part = keys[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[k][x] for x in part], pa.int64()) for k in kinds)], ["key", *kinds])

    found = sample.mapInArrow(lean(run), ", ".join(["key string", *(f"{k} bigint" for k in kinds)])).groupBy("key").agg(*[F.sum(k).alias(k) for k in kinds])
    found = written(found.filter(" + ".join(k for k in kinds if k[0] == "t") + " >= 4 or key = ''"), "words")  # as many as the sample has
    out = [_lexicon(found, [f for f in range(FOLDS) if f != without], size) for without in (None, *range(FOLDS))]
    remove(found)
    return out


def _lexicon(found: DataFrame, folds: list[int], size: int) -> Lexicon:
    found = found.select("key", *[F.expr(" + ".join(f"{y}{f}" for f in folds)).alias(y) for y in "tc"])
    all_docs = found.filter("key = ''").first()
    if not all_docs or not all_docs["t"] or not all_docs["c"]:
        return Lexicon({}, {})
    toxic, clean = all_docs["t"], all_docs["c"]
    share = toxic / (toxic + clean)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    z = (F.col("t") - (F.col("t") + F.col("c")) * share) / F.sqrt((F.col("t") + F.col("c")) * share * (1 - share))
    words = found.filter("key <> '' and t >= 4").select("key", odds.alias("w"), z.alias("z"), F.startswith("key", F.lit("\0")).alias("stem")).filter("w > 1.5 and z > 4.5")
    out = []
    for stem in (False, True):
        rows = words.filter(F.col("stem") == stem).orderBy(F.desc("z"), "key").limit(size).collect()
        out.append({r["key"].lstrip("\0"): r["w"] for r in rows})
    return Lexicon(*out)


@dataclass
class Model:
    lexicon: Lexicon
    trees: gbdt.Trees


def fit(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    sample = written(fit_sample(df, labels, label, text, id_col, fit_rows), "fit")  # the documents are read once for it
    lexicons = learn_lexicons(sample)

    def features(texts: list[str]) -> np.ndarray:
        """By each lexicon in turn, then the fold."""
        return np.concatenate([*(x.features(texts) for x in lexicons), np.array([[fold_of(t)] for t in texts], float)], 1)

    x, y = fit_matrix(sample, features)
    remove(sample)
    by_lexicon = np.split(x[:, :-1], len(lexicons), 1) if len(y) else [x]
    return Model(lexicons[0], gbdt.fit_calibrated(by_lexicon[0], y, x[:, -1].astype(int), by_lexicon[1:]))


def score(df: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", cut: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    return score_rows(df, model.lexicon.features, model.trees, cut, text, id_col)


def accepted(df: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of df that aren't predicted toxic, with all their columns."""
    return rows_below(df, model.lexicon.features, model.trees, cut, text)
