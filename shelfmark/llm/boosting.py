"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into at most ``bins`` quantile bins; trees grow level by level on histograms of
gradients and second derivatives of the logistic loss. A fitted model is a handful of flat arrays
(complete binary trees), traversed for all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right if greater; infinite where a node is not split
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (len(feature))]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 2.0, least: float = 1.0) -> Trees:
    """Fits 0/1 labels. Without rows the score is 1/2; with one class it leans to that class."""
    n, d = x.shape
    p0 = (float(np.sum(y)) + 0.5) / (n + 1.0)
    base = float(np.log(p0 / (1 - p0)))
    inner, leaves = 2**depth - 1, 2**depth
    if not n or not d:
        return Trees(base, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = bins + 1
    flat = binned + np.arange(d) * width
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (d * width) + flat).ravel()
            hg = np.bincount(at, np.repeat(g, d), count * d * width).reshape(count, d, width)
            hh = np.bincount(at, np.repeat(h, d), count * d * width).reshape(count, d, width)
            lg, lh = np.cumsum(hg, axis=2), np.cumsum(hh, axis=2)
            tg, th = lg[:, :1, -1:], lh[:, :1, -1:]
            rg, rh = tg - lg, th - lh
            gain = lg**2 / (lh + l2) + rg**2 / (rh + l2) - tg**2 / (th + l2)
            gain[(lh < least) | (rh < least)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                j, b = divmod(int(best[k]), width)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, first + k], threshold[t, first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > threshold[t][node])
        own = node - inner
        leaf[t] = rate * np.bincount(own, g, leaves) / (np.bincount(own, h, leaves) + l2)
        margin += leaf[t][own]
    return Trees(base, depth, feature, threshold, leaf)
