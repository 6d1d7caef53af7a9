"""Gradient-boosted regression trees for two classes, on histograms, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees of one depth as arrays: per inner node a feature and an edge, per leaf a value."""

    feature: np.ndarray  # trees x (2 ** depth - 1)
    edge: np.ndarray
    value: np.ndarray  # trees x 2 ** depth
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, e, v in zip(self.feature, self.edge, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(x) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > e[at])
            out += v[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, penalty: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss; a split is a bin edge of a feature's quantiles."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # x > edges[k] if code > k
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin, inner = np.full(len(y), base), 2**depth - 1
    feature, edge, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            node = at - first
            best = np.full(width, 1e-6)
            total_g, total_h = np.bincount(node, g, width), np.bincount(node, h, width)
            whole = total_g**2 / (total_h + penalty)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                n = len(e) + 1
                key = node * n + coded[:, f]
                left_g = np.cumsum(np.bincount(key, g, width * n).reshape(width, n), axis=1)[:, :-1]
                left_h = np.cumsum(np.bincount(key, h, width * n).reshape(width, n), axis=1)[:, :-1]
                gain = left_g**2 / (left_h + penalty) + (total_g[:, None] - left_g) ** 2 / (total_h[:, None] - left_h + penalty) - whole[:, None]
                k = gain.argmax(1)
                better = np.flatnonzero(gain[np.arange(width), k] > best)
                best[better] = gain[better, k[better]]
                feature[t, first + better] = f
                edge[t, first + better] = e[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > edge[t, at])
        leaf = at - inner
        value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        margin += value[t, leaf]
    return Forest(feature, edge, value, base)
