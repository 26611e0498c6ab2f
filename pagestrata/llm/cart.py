"""A small classification tree (Gini, exact splits) fitted with numpy on a bounded labelled table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Tree:
    """A binary tree in arrays; ``feature`` is -1 at a leaf, ``value`` the share of positives there."""

    def __init__(self, feature: list[int], threshold: list[float], left: list[int], right: list[int], value: list[float]):
        self.feature, self.threshold, self.left, self.right = np.array(feature), np.array(threshold), np.array(left), np.array(right)
        self.value = np.array(value)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The share of positives in each row's leaf."""
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)

    def column(self, features: list[Column], node: int = 0) -> Column:
        """The tree as a nested CASE expression over feature columns."""
        f = int(self.feature[node])
        if f < 0:
            return F.lit(float(self.value[node]))
        return F.when(features[f] <= float(self.threshold[node]), self.column(features, int(self.left[node]))).otherwise(self.column(features, int(self.right[node])))


def fit(x: np.ndarray, y: np.ndarray, max_depth: int = 10, min_leaf: int = 4) -> Tree:
    """Fit a tree to rows ``x`` (n, f) and labels ``y`` in {0, 1}; ties go to the first feature and lowest threshold."""
    feature, threshold, left, right, value = [], [], [], [], []

    def grow(idx: np.ndarray, depth: int) -> int:
        node = len(feature)
        for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, float(y[idx].mean()))):
            a.append(v)
        n, pos = len(idx), y[idx].sum()
        if depth == max_depth or n < 2 * min_leaf or pos in (0, n):
            return node
        best = (n * 2 * (pos / n) * (1 - pos / n) - 1e-9, None, None)
        for f in range(x.shape[1]):
            v = x[idx, f]
            order = np.argsort(v, kind="stable")
            vs, cum = v[order], np.cumsum(y[idx][order])
            cut = np.flatnonzero(vs[1:] > vs[:-1])
            cut = cut[(cut + 1 >= min_leaf) & (n - cut - 1 >= min_leaf)]
            if not len(cut):
                continue
            nl = cut + 1.0
            pl, nr = cum[cut] / nl, n - nl
            pr = (pos - cum[cut]) / nr
            g = 2 * nl * pl * (1 - pl) + 2 * nr * pr * (1 - pr)
            k = int(np.argmin(g))
            if g[k] < best[0]:
                best = (g[k], f, (vs[cut[k]] + vs[cut[k] + 1]) / 2)
        if best[1] is None:
            return node
        feature[node], threshold[node] = best[1], float(best[2])
        go = x[idx, best[1]] <= best[2]
        left[node] = grow(idx[go], depth + 1)
        right[node] = grow(idx[~go], depth + 1)
        return node

    grow(np.arange(len(y)), 0)
    return Tree(feature, threshold, left, right, value)
