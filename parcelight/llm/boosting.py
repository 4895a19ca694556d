"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into at most `bins` quantile bins; trees grow level by level from histograms of gradients and
Hessians of the logistic loss. A fitted model is five flat arrays over the nodes of all trees, which a batch of rows
traverses together, one level a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray  # the left child, the right one follows; a leaf is its own child
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k in range(0, len(x), 4096):
            part = x[k : k + 4096]
            at, rows = np.tile(self.roots, (len(part), 1)), np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = self.child[at] + ((part[rows, self.feature[at]] > self.threshold[at]) & (self.feature[at] >= 0))
            out[k : k + 4096] += self.value[at].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """No rows: a model that gives 0.5 everywhere."""
    n, width = x.shape
    positive = (y.sum() + 1) / (n + 2)
    base = float(np.log(positive / (1 - positive)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1) if n else np.zeros((0, width), int)
    feature, threshold, child, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(-1)
        threshold.append(0.0)
        child.append(len(feature) - 1)
        value.append(0.0)
        return len(feature) - 1

    score = np.full(n, base)
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        root = node()
        roots.append(root)
        level = [(root, np.arange(n))]
        for at_depth in range(depth + 1):
            below = []
            for at, rows in level:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best, split = 1e-6, None
                if at_depth < depth and len(rows) > 1:
                    for j in range(width):
                        size = len(cuts[j]) + 1
                        if size < 2:
                            continue
                        own = binned[rows, j]
                        left_g = np.cumsum(np.bincount(own, g[rows], size))[:-1]
                        left_h = np.cumsum(np.bincount(own, h[rows], size))[:-1]
                        count = np.cumsum(np.bincount(own, minlength=size))[:-1]
                        right_g, right_h = total_g - left_g, total_h - left_h
                        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
                        gain[(count < least) | (len(rows) - count < least)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, split = gain[k], (j, k)
                if split is None:
                    value[at] = float(rate * total_g / (total_h + ridge))
                    score[rows] += value[at]
                    continue
                j, k = split
                left = node()
                right = node()
                feature[at], threshold[at], child[at] = j, float(cuts[j][k]), left
                goes = binned[rows, j] > k
                below += [(left, rows[~goes]), (right, rows[goes])]
            level = below
    as_array = lambda v, kind: np.array(v, kind)
    return Trees(base, as_array(feature, int), as_array(threshold, float), as_array(child, int), as_array(value, float), as_array(roots, int), depth)
