"""Gradient-boosted trees for small tables, compiled into SQL expressions.

Training is plain numpy over a few hundred labelled rows on the driver;
scoring is a sum of nested CASE expressions that Spark evaluates itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf is a float; a split is (feature, threshold, left if <= threshold, right).
Tree = float | tuple


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, l2: float, least: int) -> Tree:
    value = float(gradient.sum() / (hessian.sum() + l2))
    if depth == 0 or len(x) < 2 * least:
        return value
    score = lambda g, h: g * g / (h + l2)
    best, whole = (1e-6, None), score(gradient.sum(), hessian.sum())
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], gradient[order].cumsum(), hessian[order].cumsum()
        cuts = np.nonzero(v[1:] > v[:-1])[0]
        cuts = cuts[(cuts + 1 >= least) & (cuts + 1 <= len(v) - least)]
        if len(cuts):
            gain = score(g[cuts], h[cuts]) + score(g[-1] - g[cuts], h[-1] - h[cuts]) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, float((v[cuts[k]] + v[cuts[k] + 1]) / 2)))
    if best[1] is None:
        return value
    f, t = best[1]
    left = x[:, f] <= t
    return f, t, _grow(x[left], gradient[left], hessian[left], depth - 1, l2, least), _grow(x[~left], gradient[~left], hessian[~left], depth - 1, l2, least)


def _leaf(tree: Tree, row: np.ndarray) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@dataclass
class Boosted:
    bias: float
    rate: float
    trees: list[Tree]
    #: Platt scaling of the raw score, fitted on rows that the trees haven't seen.
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.array([self.bias + self.rate * sum(_leaf(t, row) for t in self.trees) for row in x])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def column(self, feature) -> Column:
        """The calibrated probability; feature(k) is the column of feature k."""

        def of(tree: Tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            return F.when(feature(tree[0]) <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        raw = F.lit(self.bias)
        for tree in self.trees:
            raw = raw + F.lit(self.rate) * of(tree)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * raw + F.lit(self.shift))))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: int = 4) -> Boosted:
    """Logistic loss, second-order leaves; the same trees for the same rows."""
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(prior / (1 - prior))), rate, [])
    raw = np.full(len(y), model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(x, y - p, p * (1 - p), depth, l2, least)
        model.trees.append(tree)
        raw += rate * np.array([_leaf(tree, row) for row in x])
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, rounds: int = 50) -> Boosted:
    """Platt scaling by Newton steps, with a weak pull to slope 1 and shift 0."""
    raw = model.raw(x)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        w = p * (1 - p)
        g = np.array([((y - p) * raw).sum() - (a - 1), (y - p).sum() - b])
        h = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1]])
        da, db = np.linalg.solve(h, g)
        a, b = a + da, b + db
    model.slope, model.shift = float(a), float(b)
    return model


def threshold_for(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold from which on at least `precision` of the rows above are positive; 0.5 at least."""
    best = 1.0
    for t in sorted({*probability.tolist(), 0.5}, reverse=True):
        above = probability >= t
        if above.any() and y[above].mean() >= precision:
            best = t
    return max(0.5, best - 1e-9)
