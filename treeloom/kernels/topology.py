"""A sequence of trees along a section of the genome."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from treeloom.kernels import building, mapping
from treeloom.kernels.painting import distances, paint
from treeloom.operators.trees import Tree


@dataclass
class Section:
    """trees with the site at which each starts; tree and placement of every site; events of each branch."""

    starts: list[int]
    trees: list[Tree]
    tree_of: list[int]
    placements: list[mapping.Placement]
    events: list[np.ndarray]


def build_section(haps: np.ndarray, r: np.ndarray, rpos: np.ndarray, theta: float = 0.001, state: np.ndarray | None = None, pos: np.ndarray | None = None, force_every: int | None = None, consistent: bool = True) -> Section:
    """One ordered pass over haps[site, haplotype].

    The tree goes on while mutations map. Where one doesn't, a tree is built there; it is taken if the mutation maps to
    it or fits strictly better, or if a multiple of force_every bases was passed. consistent favours clades of the tree
    before and of the carriers. state: 1 for sites whose events count.
    """
    length, n = haps.shape
    state = np.ones(length, int) if state is None else state
    paintings = [paint(haps, r, k, theta) for k in range(n)]
    out = Section([], [], [], [], [])

    def at(site: int, before: Tree | None) -> Tree:
        d = distances(paintings, site, rpos)
        if before is None or not consistent:
            return building.build(d, theta)
        own = haps[site] == 1
        d = d + np.outer(own, ~own) * -np.log(theta / (1 - theta))
        return building.build(d, theta, prior=building.clade_prior(before))

    for site in range(length):
        if not out.trees:
            out.starts.append(site)
            out.trees.append(at(site, None))
            out.events.append(np.zeros(2 * n - 1))
        placed = mapping.place(out.trees[-1], haps[site])
        forced_here = force_every is not None and pos is not None and site > 0 and pos[site] // force_every > pos[site - 1] // force_every
        if placed.kind == 3 or forced_here:
            fresh = at(site, out.trees[-1])
            new = mapping.place(fresh, haps[site])
            better = new.kind != 3 or len(new.branches) < len(placed.branches)
            if forced_here or placed.kind == 3 and better:
                out.starts.append(site)
                out.trees.append(fresh)
                out.events.append(np.zeros(2 * n - 1))
                placed = new
        out.tree_of.append(len(out.trees) - 1)
        out.placements.append(placed)
        if placed.kind != 3 and placed.branches and state[site]:
            out.events[-1][placed.branches[0]] += 1
    return out


def carried(section: Section, last: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Events, first and last site of every branch, summed over the branches that continue it."""
    links = [mapping.equivalent(a, b) for a, b in zip(section.trees, section.trees[1:])]  # noqa: B905
    ids = mapping.chains(links, [t.size for t in section.trees])
    ends = [*[s - 1 for s in section.starts[1:]], last]
    total = max((int(x.max()) for x in ids), default=-1) + 1
    events, begin, end = np.zeros(total), np.full(total, np.iinfo(int).max), np.full(total, -1)
    for x, e, s, z in zip(ids, section.events, section.starts, ends, strict=True):
        np.add.at(events, x, e)
        np.minimum.at(begin, x, s)
        np.maximum.at(end, x, z)
    return [events[x] for x in ids], [begin[x] for x in ids], [end[x] for x in ids]
