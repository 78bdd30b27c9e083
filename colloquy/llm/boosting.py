"""Small gradient-boosted trees: trained with numpy on a bounded sample, applied as a built-in expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A leaf (``feature`` is -1) or a split: ``value < threshold`` goes left."""

    feature: int = -1
    threshold: float = 0.0
    value: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, penalty: float) -> Node:
    gain_of = lambda gs, hs: gs * gs / (hs + penalty)
    best, node = 1e-6, Node(value=float(-g.sum() / (h.sum() + penalty)))
    if depth == 0 or len(g) < 4:
        return node
    total = gain_of(g.sum(), h.sum())
    for f, thresholds in enumerate(cuts):
        for t in thresholds:
            m = x[:, f] < t
            if not 0 < m.sum() < len(m):
                continue
            gain = gain_of(g[m].sum(), h[m].sum()) + gain_of(g[~m].sum(), h[~m].sum()) - total
            if gain > best:
                best, node.feature, node.threshold = gain, f, float(t)
    if node.feature >= 0:
        m = x[:, node.feature] < node.threshold
        node.left = _grow(x[m], g[m], h[m], cuts, depth - 1, penalty)
        node.right = _grow(x[~m], g[~m], h[~m], cuts, depth - 1, penalty)
    return node


def _apply(n: Node, x: np.ndarray) -> np.ndarray:
    if n.feature < 0:
        return np.full(len(x), n.value)
    return np.where(x[:, n.feature] < n.threshold, _apply(n.left, x), _apply(n.right, x))


@dataclass
class Booster:
    """Log odds = ``bias`` + the sum of the trees' leaves."""

    bias: float
    trees: list[Node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def one(self, x: list[float]) -> float:
        """The log odds of one row, without arrays."""
        out = self.bias
        for n in self.trees:
            while n.feature >= 0:
                n = n.left if x[n.feature] < n.threshold else n.right
            out += n.value
        return out

    def column(self, features: list[Column]) -> Column:
        """The log odds as one expression over ``features`` (doubles without nulls)."""

        def walk(n: Node) -> Column:
            if n.feature < 0:
                return F.lit(n.value)
            return F.when(features[n.feature] < n.threshold, walk(n.left)).otherwise(walk(n.right))

        out = F.lit(self.bias)
        for t in self.trees:
            out = out + walk(t)
        return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 25, depth: int = 2, rate: float = 0.4, bins: int = 12, penalty: float = 1.0) -> Booster:
    """Logistic boosting of ``y`` (0/1) on ``x``; without rows, or with one class only, a constant."""
    if len(y) == 0:
        return Booster(0.0, [])
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Booster(float(np.log(p / (1 - p))), [])
    if y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 2)[1:-1])) for f in range(x.shape[1])]
    cuts = [np.unique(np.r_[c, np.unique(x[:, f])[1:] if len(np.unique(x[:, f])) <= bins else []]) for f, c in enumerate(cuts)]
    score = np.full(len(y), model.bias)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        tree = _grow(x, q - y, np.maximum(q * (1 - q), 1e-6), cuts, depth, penalty)
        for leaf in _leaves(tree):
            leaf.value *= rate
        model.trees.append(tree)
        score = score + _apply(tree, x)
    return model


def _leaves(n: Node):
    if n.feature < 0:
        yield n
    else:
        yield from _leaves(n.left)
        yield from _leaves(n.right)
