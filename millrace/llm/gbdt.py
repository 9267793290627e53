"""Histogram gradient-boosted trees for a binary label, as flat arrays, and isotonic calibration.

Features are cut to at most BINS bins by quantiles of the fit rows. Trees are
complete binary trees of one depth, node k's children at 2k+1 and 2k+2, so a
batch walks down all of them with `depth` gathers a tree and no branches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Trees:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes: right if greater
    leaf: np.ndarray  # trees x leaves
    base: float
    depth: int
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the calibration
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds for rows of x; a NaN goes left."""
        rows, inner, out = np.arange(len(x)), (1 << self.depth) - 1, np.full(len(x), self.base)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, calibrated if a calibration was learned."""
        raw = self.raw(x)
        if len(self.knots):
            return np.interp(raw, self.knots, self.levels)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: int = 10) -> Trees:
    """Newton boosting of the log loss; leaves hold `least` rows, fewer for fits on a few hundred. Labels of one kind, or no rows, give a constant."""
    n, width = x.shape
    least = max(2, min(least, n // 50))
    share = (y.sum() + 0.5) / (n + 1)
    base, inner, leaves = float(np.log(share / (1 - share))), (1 << depth) - 1, 1 << depth
    if n < 2 * least or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base, depth)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])  # bin > k means x > cuts[k]
    raw, out = np.full(n, base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node, feature, threshold = np.zeros(n, np.int64), np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            here = node - first
            best, choice = np.full(count, 1e-6), [None] * count
            for f in range(width):
                slot = here * BINS + binned[f]
                g, h, c = (np.bincount(slot, w, count * BINS).reshape(count, BINS).cumsum(1) for w in (grad, hess, None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
                gain[(c < least) | (ct - c < least)] = 0
                gain = gain[:, : len(cuts[f])]
                if gain.shape[1]:
                    k = gain.argmax(1)
                    for j in np.flatnonzero(gain[np.arange(count), k] > best):
                        best[j], choice[j] = gain[j, k[j]], (f, k[j])
            go = np.zeros(n, bool)
            for j, found in enumerate(choice):
                if found:
                    f, k = found
                    feature[first + j], threshold[first + j] = f, cuts[f][k]
                    go |= (here == j) & (binned[f] > k)
            node = 2 * node + 1 + go
        at = node - inner
        value = -rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + l2)
        raw += value[at]
        for kept, new in zip(out, (feature, threshold, value), strict=True):
            kept.append(new)
    return Trees(*map(np.array, out), base, depth)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the non-decreasing fit of y to score (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], y[order].astype(float)
    means, weights, lows, highs = [], [], [], []
    for a, b in zip(s.tolist(), y.tolist(), strict=True):
        means.append(b), weights.append(1.0), lows.append(a), highs.append(a)
        while len(means) > 1 and (means[-2] >= means[-1] or highs[-2] == lows[-1]):
            w, m, h = weights.pop(), means.pop(), highs.pop()
            lows.pop()
            means[-1] = (means[-1] * weights[-1] + m * w) / (weights[-1] + w)
            weights[-1] += w
            highs[-1] = h
    knots = np.array([x for pair in zip(lows, highs, strict=True) for x in pair])
    w = np.repeat(weights, 2)
    levels = (np.repeat(means, 2) * w + 0.5) / (w + 1)  # pulled a little from 0 and 1
    levels = np.maximum.accumulate(levels)
    apart = np.concatenate([[True], np.diff(knots) > 0])
    return knots[apart], levels[apart]


def fit_calibrated(x: np.ndarray, y: np.ndarray, part: np.ndarray | None = None, x_of: list[np.ndarray] | None = None, folds: int = 3, **options) -> Trees:
    """fit() on all rows, calibrated on what models of the other folds say of each fold.

    part: each row's fold. x_of: the features as they are made without the
    labels of fold 0, 1, .., where features depend on labels.
    """
    model = fit(x, y, **options)
    if len(model.feature):
        part, raw = np.arange(len(y)) % folds if part is None else part, np.zeros(len(y))
        for k in np.unique(part).tolist():
            own = x if x_of is None else x_of[k]
            raw[part == k] = fit(own[part != k], y[part != k], **options).raw(own[part == k])
        model.knots, model.levels = isotonic(raw, y)
    return model
