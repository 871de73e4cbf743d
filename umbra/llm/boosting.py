"""Small gradient-boosted trees: fitted on the driver, applied as SQL expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class BoostedTrees:
    """Logistic gradient boosting of shallow regression trees over a few numeric features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.base = math.log(share / (1 - share))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            margin += self._values(tree, x)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> float | tuple:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = None
        if depth:
            for feature in range(x.shape[1]):
                order = np.argsort(x[rows, feature], kind="stable")
                values = x[rows[order], feature]
                ends = np.flatnonzero(values[1:] != values[:-1])
                ends = ends[(ends + 1 >= self.least) & (len(rows) - ends - 1 >= self.least)]
                if not len(ends):
                    continue
                gl, hl = g[rows[order]].cumsum()[ends], h[rows[order]].cumsum()[ends]
                gain = gl * gl / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1)
                at = int(gain.argmax())
                if best is None or gain[at] > best[0] + 1e-12:
                    cut = float(values[ends[at] + 1])
                    left = x[rows, feature] < cut
                    best = (float(gain[at]), feature, cut, rows[left], rows[~left])
        if best is None or best[0] <= total_g**2 / (total_h + 1) + 1e-9:
            return float(self.rate * total_g / (total_h + 1))
        _, feature, cut, left, right = best
        return feature, cut, self._grow(x, g, h, left, depth - 1), self._grow(x, g, h, right, depth - 1)

    def _values(self, tree: float | tuple, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        feature, cut, left, right = tree
        return np.where(x[:, feature] < cut, self._values(left, x), self._values(right, x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for tree in self.trees:
            margin += self._values(tree, x)
        return 1 / (1 + np.exp(-margin))

    def _padded(self, tree: float | tuple, depth: int) -> dict:
        """A tree filled up to its full depth, level by level: features, cuts and the leaves' values."""
        level, features, cuts = [tree], [], []
        for _ in range(depth):
            below: list = []
            for node in level:
                inner = isinstance(node, tuple)
                features.append(node[0] if inner else 0)
                cuts.append(node[1] if inner else 0.0)
                below += node[2:] if inner else (node, node)
            level = below
        return {"f": features, "c": cuts, "v": level}

    def column(self, features: Column) -> Column:
        """The probability as an expression over an array of features; the trees are a constant table, so plans stay small."""
        if not self.trees:
            return F.lit(1 / (1 + math.exp(-self.base)))
        rows = json.dumps([self._padded(t, self.depth) for t in self.trees])
        trees = F.from_json(F.lit(rows), "array<struct<f:array<int>,c:array<double>,v:array<double>>>")
        step = lambda t: lambda i, _: F.when(F.get(features, F.get(t["f"], i)) < F.get(t["c"], i), 2 * i + 1).otherwise(2 * i + 2)
        leaf = lambda t: F.get(t["v"], F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), step(t)) - (2**self.depth - 1))
        margin = F.aggregate(trees, F.lit(self.base), lambda total, t: total + leaf(t))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def threshold(p: np.ndarray, y: np.ndarray, precision: float, least: float = 0.5) -> float:
    """Where at least ``precision`` of the calibration examples from there on are right: half way between the lowest
    such probability and the next lower one, ``least`` at any rate; over 1 if there is none."""
    cuts, best = np.unique(p), 1.01
    for i in range(len(cuts) - 1, -1, -1):
        if y[p >= cuts[i]].mean() >= precision:
            best = max(least, float(cuts[i] + (cuts[i - 1] if i else 0.0)) / 2)
    return best
