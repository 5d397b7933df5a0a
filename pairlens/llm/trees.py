"""Small regression trees on binned features, for boosting and for forests.

Fitted on the driver from a bounded sample; what comes out is plain arrays, or a column
expression that scores inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """Node i splits at ``feature[i]`` <= ``threshold[i]`` into 2i + 1 and 2i + 2; a feature of -1 makes a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            f = np.where(inner, self.feature[at], 0)
            at = np.where(inner, 2 * at + 1 + (x[rows, f] > self.threshold[at]), at)
        return self.value[at]

    def column(self, features: list[Column], at: int = 0) -> Column:
        f = int(self.feature[at])
        if f < 0:
            return F.lit(float(self.value[at]))
        return F.when(features[f] <= float(self.threshold[at]), self.column(features, 2 * at + 1)).otherwise(self.column(features, 2 * at + 2))


def votes(trees: list[Tree], features: Column) -> Column:
    """The mean value of ``trees`` for an array of features.

    The trees are literal arrays that are walked level by level: the plan stays small, however many nodes they have.
    """
    size = max(len(t.feature) for t in trees)

    def literal(values: list, kind: str) -> Column:
        return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")

    def all_(name: str) -> list:
        return [v for t in trees for v in [*getattr(t, name).tolist(), *[-1] * (size - len(t.feature))]]

    feature, threshold, value = literal(all_("feature"), "int"), literal([repr(float(v)) for v in all_("threshold")], "double"), literal([repr(float(v)) for v in all_("value")], "double")
    levels = F.sequence(F.lit(1), F.lit(size.bit_length() - 1)) if size > 1 else F.array().cast("array<int>")

    def leaf(tree: Column) -> Column:
        first = tree * size + 1

        def step(at: Column, _: Column) -> Column:
            f = F.element_at(feature, first + at)
            right = F.element_at(features, f + 1) > F.element_at(threshold, first + at)
            return F.when(f < 0, at).otherwise(2 * at + 1 + right.cast("int"))

        return F.element_at(value, first + F.aggregate(levels, F.lit(0), step))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(trees) - 1)), F.lit(0.0), lambda a, t: a + leaf(t)) / len(trees)


def edges(x: np.ndarray, bins: int = 32) -> list[np.ndarray]:
    """Cuts between the quantiles of each feature."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


def grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float, ridge: float, chooser: np.random.Generator | None = None, share: float = 1.0) -> Tree:
    """A tree whose leaves hold gradient over hessian; with a chooser each node sees a share of the features."""
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    size = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    waiting = [(0, np.arange(len(x)), 0)]
    while waiting:
        node, rows, level = waiting.pop()
        g, h = gradient[rows].sum(), hessian[rows].sum()
        value[node] = g / (h + ridge) if h + ridge > 0 else 0.0
        if level == depth or h < 2 * least:
            continue
        best = (1e-9, -1, 0)
        seen = range(x.shape[1]) if chooser is None else chooser.permutation(x.shape[1])[: max(1, round(share * x.shape[1]))]
        for f in seen:
            n = len(cuts[f]) + 1
            gs = np.cumsum(np.bincount(binned[rows, f], gradient[rows], n))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, f], hessian[rows], n))[:-1]
            fits = (hs >= least) & (h - hs >= least)
            if not fits.any():
                continue
            gain = np.where(fits, gs**2 / (hs + ridge + 1e-12) + (g - gs) ** 2 / (h - hs + ridge + 1e-12) - g**2 / (h + ridge + 1e-12), -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] < 0:
            continue
        feature[node], threshold[node] = best[1], cuts[best[1]][best[2]]
        goes_left = binned[rows, best[1]] <= best[2]
        waiting += [(2 * node + 1, rows[goes_left], level + 1), (2 * node + 2, rows[~goes_left], level + 1)]
    return Tree(feature, threshold, value)


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2) -> tuple[float, list[Tree]]:
    """Gradient boosting of log odds: the start value and the trees, to be added up."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    margin, cuts, found = np.full(len(y), start), edges(x), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(x, cuts, y - p, p * (1 - p), depth, least=1.0, ridge=1.0)
        tree = Tree(tree.feature, tree.threshold, rate * tree.value)
        margin += tree(x)
        found.append(tree)
    return start, found


def forest(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 6, seed: int = 7) -> list[Tree]:
    """A random forest: bootstrapped rows, a share of the features at each node, leaves hold the share of ones."""
    chooser = np.random.default_rng(seed)
    cuts, share = edges(x), np.sqrt(x.shape[1]) / x.shape[1]
    found = []
    for _ in range(trees):
        counts = np.bincount(chooser.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        found.append(grow(x, cuts, y * counts, counts, depth, least=3.0, ridge=0.0, chooser=chooser, share=float(share)))
    return found


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing knots (score, share of ones), to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    knots, shares = np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
    return knots, shares
