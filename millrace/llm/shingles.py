"""Sets of hashed word shingles for batches of texts, in numpy.

A word's hash takes in its bytes eight at a time, each time scrambled one to one,
and its length: words of up to seven bytes never collide, and no algebra of the
letters makes longer ones do. Shingles mix the hashes of their words in order.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_U = np.uint64
#: A-Z to a-z, byte by byte.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = (1 << 64) - 1
_STEP = 0xC2B2AE3D27D4EB4F
#: What is left of eight bytes if so many belong to the word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Longer words, in bytes, are hashed one by one.
LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the texts, lower-cased; bounds of each text's words, one more than texts)."""
    parts = [t.encode().translate(_LOWER) for t in texts]
    joined = b" " + b" ".join(parts) + b" " * 9
    space = _SPACE[np.frombuffer(joined, np.uint8)]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    size = np.flatnonzero(~space[:-1] & space[1:]) + 1 - starts
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))  # the eight bytes from every place on
    first = eight[starts] & _FIRST[np.minimum(size, 8)]
    words = mixed(first ^ (size.astype(_U) << _U(56)))
    at = np.flatnonzero((size >= 8) & (size <= LONG))
    state, done = mixed(first[at] + size[at].astype(_U) * _U(_STEP)), 8
    while len(at):
        words[at] = state
        more = size[at] > done
        at, state = at[more], state[more]
        state = mixed((state ^ (state >> _U(32))) * _U(_STEP) + (eight[starts[at] + done] & _FIRST[np.minimum(size[at] - done, 8)]))
        done += 8
    for k in np.flatnonzero(size > LONG).tolist():
        words[k] = int.from_bytes(blake2b(joined[starts[k] : starts[k] + size[k]], digest_size=8).digest(), "little")
    offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]) + 1
    return words, np.searchsorted(starts, offsets)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; fewer words are one shingle, no word none."""
    words, bounds = word_hashes(texts)
    n = max(len(words) - k + 1, 0)
    rolled = np.zeros(n, _U)
    for i in range(k):
        rolled = (rolled ^ (rolled >> _U(29))) * _U(_STEP) + words[i : i + n]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = b - a
            for w in words[a:b].tolist():
                short = ((short ^ (short >> 29)) * _STEP + w) & _MASK
            out.append(mixed(np.array([short], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out
