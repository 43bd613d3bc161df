"""A small random forest on bounded tables, and its trees as SQL expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Leaf:
    share: float


@dataclass
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split


def _gini_gain(y: np.ndarray) -> np.ndarray:
    """For labels sorted by a feature: twice the impurity left when the first 1 .. n - 1 rows are split off."""
    n = len(y)
    left = np.cumsum(y)[:-1]
    k = np.arange(1, n)
    right = y.sum() - left
    return left * (1 - left / k) + right * (1 - right / (n - k))


def _grow(x: np.ndarray, y: np.ndarray, depth: int, tried: int, rnd: np.random.Generator) -> Leaf | Split:
    if depth == 0 or len(y) < 4 or y.min() == y.max():
        return Leaf(round(float(y.mean()), 4))
    best = (np.inf, -1, 0.0)
    for f in rnd.permutation(x.shape[1])[:tried]:
        by = np.argsort(x[:, f], kind="stable")
        v = x[by, f]
        rest = np.where(v[1:] > v[:-1], _gini_gain(y[by]), np.inf)
        i = int(np.argmin(rest)) if len(rest) else 0
        if len(rest) and rest[i] < best[0]:
            best = (rest[i], int(f), float((v[i] + v[i + 1]) / 2))
    if best[1] < 0:
        return Leaf(round(float(y.mean()), 4))
    low = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], _grow(x[low], y[low], depth - 1, tried, rnd), _grow(x[~low], y[~low], depth - 1, tried, rnd))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, seed: int = 17) -> list[Leaf | Split]:
    """Each tree on rows drawn with replacement, each split on the best of a random part of the features."""
    rnd = np.random.default_rng(seed)
    tried = max(2, int(np.ceil(np.sqrt(x.shape[1]))) + 1)
    out = []
    for _ in range(trees):
        rows = rnd.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows].astype(float), depth, tried, rnd))
    return out


def vote(trees: list[Leaf | Split], feature: Callable[[int], Column]) -> Column:
    """Mean share of the trees' leaves, as one expression of the features."""

    def of(node: Leaf | Split) -> Column:
        return F.lit(node.share) if isinstance(node, Leaf) else F.when(feature(node.feature) <= node.at, of(node.low)).otherwise(of(node.high))

    total = of(trees[0])
    for t in trees[1:]:
        total = total + of(t)
    return total / len(trees)


def score(trees: list[Leaf | Split], x: np.ndarray) -> np.ndarray:
    """The same in numpy, for tests."""

    def of(node: Leaf | Split, row: np.ndarray) -> float:
        while isinstance(node, Split):
            node = node.low if row[node.feature] <= node.at else node.high
        return node.share

    return np.array([sum(of(t, r) for t in trees) / len(trees) for r in x])
