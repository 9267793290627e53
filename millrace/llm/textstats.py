"""Counts of characters by class for batches of texts, in numpy, and word and line figures."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Character classes.
OTHER, SPACE, LOWER, UPPER, DIGIT, PUNCT, SYMBOL, NEWLINE = range(8)
CLASSES = 8
#: What counts as punctuation of prose; other ASCII marks are symbols.
PROSE_MARKS = ".,;:!?'\"()-"


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s == "\n":
            out[c] = NEWLINE
        elif s.isspace():
            out[c] = SPACE
        elif s.isalpha():
            out[c] = UPPER if s.isupper() else LOWER
        elif s.isdigit():
            out[c] = DIGIT
        elif c < 128:
            out[c] = PUNCT if s in PROSE_MARKS else SYMBOL
    return out


def class_counts(texts: list[str]) -> np.ndarray:
    """texts x CLASSES; texts may be empty."""
    sizes = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    slot = np.repeat(np.arange(len(texts)) * CLASSES, sizes) + class_table()[cp]
    return np.bincount(slot, minlength=len(texts) * CLASSES).reshape(len(texts), CLASSES).astype(float)
