"""Gradient-boosted trees for two classes: logistic loss, histogram splits, full trees of a fixed depth, plain numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    def __init__(self, trees: list, start: float, depth: int):
        self.trees, self.start, self.depth = trees, start, depth

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Features are cut at ``bins`` quantiles at most; every split is the one of the largest gain, ties by feature and cut."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    total, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = at - first
            best = np.full(n, 1e-6)
            size = np.bincount(local, minlength=n)
            gs, hs = np.bincount(local, g, n), np.bincount(local, h, n)
            where = np.zeros(n, np.int64)
            for f in range(len(edges)):
                k = len(edges[f]) + 1
                if k == 1:
                    continue
                key = local * k + binned[f]
                gl = np.bincount(key, g, n * k).reshape(n, k).cumsum(1)[:, :-1]
                hl = np.bincount(key, h, n * k).reshape(n, k).cumsum(1)[:, :-1]
                gain = gl**2 / (hl + ridge) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + ridge) - (gs**2 / (hs + ridge))[:, None]
                gain[size < 8] = 0
                b = gain.argmax(1)
                found = gain[np.arange(n), b]
                better = found > best + 1e-9
                best[better], where[better] = found[better], b[better]
                feature[first : first + n][better] = f
                cut[first : first + n][better] = edges[f][b[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        trees.append((feature, cut, value))
        total += value[leaf]
    return Trees(trees, start, depth)
