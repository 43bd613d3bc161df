"""Agglomerative trees from asymmetric distances."""

from __future__ import annotations

import numpy as np

from treeloom.operators.trees import Tree


def threshold(theta: float, scale: float = 0.2) -> float:
    """How far above its row's least a distance may lie to be near it."""
    return -scale * np.log(theta / (1 - theta))


def build(d: np.ndarray, theta: float = 0.001, ages: np.ndarray | None = None, prior: np.ndarray | None = None) -> Tree:
    """The tree that joins mutually nearest clusters first.

    i and j are candidates if d[i, j] lies within the threshold of i's least distance and d[j, i] of j's; of these the
    pair with the least sum is joined, ties by lower numbers. Without a candidate the symmetrised matrix decides. A
    joined cluster takes size-weighted means in both directions. prior is a second matrix: candidates that it has as
    mutually near as well come first. With ages, a cluster younger than the running age of the next coalescence goes
    before older ones. Tips are 0 .. n-1 and clusters n, n+1, ... in the order of joining.
    """
    d = np.array(d, float)
    n = len(d)
    parent = np.full(max(2 * n - 1, 0), -1)
    if n < 2:
        return Tree(parent)
    near, close = threshold(theta), threshold(theta, 0.001)
    q = None if prior is None else np.array(prior, float)
    size = np.ones(n)
    label = np.arange(n)
    age = np.zeros(n) if ages is None else np.asarray(ages, float).copy()
    expected = 0.0
    for new in range(n, 2 * n - 1):
        m = len(label)
        off = ~np.eye(m, dtype=bool)
        if ages is not None:
            young = age <= expected
            if young.sum() < 2:
                expected = np.sort(age)[1]
                young = age <= expected
            # the time in which this many lineages coalesce, on the scale of the ages
            k = int(young.sum())
            expected += 2.0 / (k * (k - 1))
            allowed = off & young[:, None] & young[None, :]
        else:
            allowed = off
        within = np.where(off, d, np.inf)
        low = within.min(axis=1)
        good = allowed & (within <= low[:, None] + near)
        good &= good.T
        cost = d + d.T
        if q is not None:
            other = np.where(off, q, np.inf)
            both = other <= other.min(axis=1)[:, None] + close
            cost = np.where(both & both.T, 0.0, cost)
        if not good.any():
            good = allowed
            cost = d + d.T
        choice = np.where(np.triu(good, 1), cost, np.inf)
        i, j = divmod(int(choice.argmin()), m)
        parent[label[i]] = parent[label[j]] = new
        w = size[i] / (size[i] + size[j])
        for x in (d, q):
            if x is not None:
                x[i, :] = w * x[i, :] + (1 - w) * x[j, :]
                x[:, i] = w * x[:, i] + (1 - w) * x[:, j]
                x[i, i] = 0.0
        size[i] += size[j]
        label[i] = new
        age[i] = max(age[i], age[j], expected if ages is not None else 0.0)
        keep = np.arange(m) != j
        d, size, label, age = d[np.ix_(keep, keep)], size[keep], label[keep], age[keep]
        q = None if q is None else q[np.ix_(keep, keep)]
    return Tree(parent)


def upgma(d: np.ndarray) -> Tree:
    """Average linkage on the symmetrised matrix, with lengths."""
    d = (np.array(d, float) + np.array(d, float).T) / 2
    n = len(d)
    parent, length = np.full(2 * n - 1, -1), np.zeros(2 * n - 1)
    size, label, height = np.ones(n), np.arange(n), np.zeros(2 * n - 1)
    for new in range(n, 2 * n - 1):
        m = len(label)
        i, j = divmod(int(np.where(np.triu(np.ones((m, m), bool), 1), d, np.inf).argmin()), m)
        height[new] = max(d[i, j] / 2, height[label[i]], height[label[j]])
        for x in (i, j):
            parent[label[x]], length[label[x]] = new, height[new] - height[label[x]]
        w = size[i] / (size[i] + size[j])
        d[i, :] = w * d[i, :] + (1 - w) * d[j, :]
        d[:, i] = d[i, :]
        d[i, i] = 0
        size[i] += size[j]
        label[i] = new
        keep = np.arange(m) != j
        d, size, label = d[np.ix_(keep, keep)], size[keep], label[keep]
    return Tree(parent, length)


def clade_prior(tree: Tree) -> np.ndarray:
    """Distances by an earlier tree: the number of its clades that hold the row's tip but not the column's."""
    out = np.zeros((tree.n, tree.n))
    for c in tree.clades()[tree.n :]:
        inside = np.array([c >> i & 1 for i in range(tree.n)], float)
        out += np.outer(inside, 1 - inside)
    return out
