"""Placing mutations on trees and following branches from tree to tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from treeloom.operators.trees import Tree, clade_correlation

#: Shares of missed carriers and of included others that a branch may have, and the purity that it needs.
MISSED, PURE = 0.3, 0.7
#: Mismatches that still map, as a share of all haplotypes; and least correlation of equivalent branches.
MISMATCH, CORRELATED, EQUAL = 0.03, 0.95, 0.9999


@dataclass
class Placement:
    """branches: none, one, or several if the mutation doesn't map; flipped if the branch carries the other allele."""

    branches: list[int]
    flipped: bool
    mismatch: int

    @property
    def kind(self) -> int:
        """1 maps, 2 maps flipped, 3 doesn't."""
        return 3 if len(self.branches) > 1 or self.mismatch < 0 else 2 if self.flipped else 1


def _counts(tree: Tree, carriers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carriers and other tips below each node."""
    own, rest = np.zeros(tree.size, int), np.zeros(tree.size, int)
    own[: tree.n], rest[: tree.n] = carriers, 1 - carriers
    for v in tree.upward():
        if tree.parent[v] >= 0:
            own[tree.parent[v]] += own[v]
            rest[tree.parent[v]] += rest[v]
    return own, rest


def _best(own: np.ndarray, rest: np.ndarray, n_own: int, n_rest: int) -> tuple[int, int]:
    """(branch, mismatches) of the feasible branch with the fewest, -1 if none is feasible."""
    below = own + rest
    with np.errstate(divide="ignore", invalid="ignore"):
        feasible = ((n_own - own) / n_own < MISSED) & (rest / max(n_rest, 1) < MISSED)
        feasible &= own / below > PURE
        outside = n_own + n_rest - below
        feasible &= np.where(outside > 0, (n_rest - rest) / outside > PURE, True)
    cost = np.where(feasible, (n_own - own) + rest, np.iinfo(int).max)
    v = int(cost.argmin())
    return (v, int(cost[v])) if feasible.any() else (-1, -1)


def place(tree: Tree, carriers: np.ndarray) -> Placement:
    """The branch whose clade fits the carriers best, in either polarity; a tie is not flipped.

    No carriers: no branch, maps. All carriers: the root. Otherwise, if the best has more than MISMATCH of all
    haplotypes wrong, the fewest pure clades that hold all carriers, each with at most MISMATCH of others.
    """
    carriers = np.asarray(carriers, int)
    n, total = tree.n, int(np.sum(carriers))
    if total == 0:
        return Placement([], False, 0)
    if total == n:
        return Placement([tree.root], False, 0)
    own, rest = _counts(tree, carriers)
    a, miss_a = _best(own, rest, total, n - total)
    b, miss_b = _best(rest, own, n - total, total)
    most = int(MISMATCH * n)
    if a >= 0 and miss_a <= most and (b < 0 or miss_a <= miss_b):
        return Placement([a], False, miss_a)
    if b >= 0 and miss_b <= most:
        return Placement([b], True, miss_b)
    return Placement(forced(tree, carriers), False, -1)


def forced(tree: Tree, carriers: np.ndarray) -> list[int]:
    """The highest branches with at most MISMATCH of their tips without the mutation, that hold all carriers."""
    own, rest = _counts(tree, np.asarray(carriers, int))
    out, todo = [], [tree.root]
    while todo:
        v = todo.pop()
        if own[v] and rest[v] <= MISMATCH * (own[v] + rest[v]):
            out.append(v)
        elif own[v]:
            todo += tree.children[v]
    return sorted(out)


def parsimony(tree: Tree, carriers: np.ndarray) -> list[int]:
    """Branches below which all tips carry the mutation, as high as possible."""
    own, rest = _counts(tree, np.asarray(carriers, int))
    return sorted(v for v in range(tree.size) if own[v] and not rest[v] and (tree.parent[v] < 0 or rest[tree.parent[v]]))


def equivalent(a: Tree, b: Tree) -> np.ndarray:
    """For each branch of a the branch of b that continues it, -1 if none; one to one.

    Tips go with themselves if their parents' clades are equal or correlated. Inner branches with equal clades below
    equal parents go first; of the others the best correlated pairs, in the branch and in its parent.
    """
    n = a.n
    ca, cb = a.clades(), b.clades()
    out = np.full(a.size, -1)
    r = clade_correlation(ca, cb, n)

    def parent_r(i: int, j: int) -> float:
        p, q = a.parent[i], b.parent[j]
        return 1.0 if p < 0 and q < 0 else 0.0 if p < 0 or q < 0 else r[p, q]

    for t in range(n):
        sister = [ca[c] for c in a.children[a.parent[t]] if c != t] == [cb[c] for c in b.children[b.parent[t]] if c != t]
        if sister or parent_r(t, t) >= CORRELATED:
            out[t] = t
    taken = np.zeros(b.size, bool)
    rows, cols = np.nonzero(r[n:, n:] >= CORRELATED)
    pairs = [(i + n, j + n) for i, j in zip(rows.tolist(), cols.tolist(), strict=True)]
    for i, j in pairs:
        if out[i] < 0 and not taken[j] and r[i, j] >= EQUAL and parent_r(i, j) >= EQUAL:
            out[i] = j
            taken[j] = True
    for i, j in sorted(pairs, key=lambda x: (-r[x], x)):
        if out[i] < 0 and not taken[j] and parent_r(i, j) >= CORRELATED:
            out[i] = j
            taken[j] = True
    return out


def chains(links: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """Chain number of every branch of successive trees: a branch shares the number of the one that it continues."""
    out = [np.arange(sizes[0])] if sizes else []
    top = sizes[0] if sizes else 0
    for link, size in zip(links, sizes[1:], strict=True):
        own = np.full(size, -1)
        for i, j in enumerate(link.tolist()):
            if j >= 0:
                own[j] = out[-1][i]
        fresh = np.flatnonzero(own < 0)
        own[fresh] = top + np.arange(len(fresh))
        top += len(fresh)
        out.append(own)
    return out
