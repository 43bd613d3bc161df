"""Painting each haplotype as a mosaic of the others, and the distances that follow.

At a site where haplotype k is derived, another one emits 1 - theta if it is derived as
well, else theta; sites where k is ancestral carry no information about it. Between visited
sites the copied haplotype changes with probability 1 - exp(-R), R the summed genetic steps.
Vectors are rescaled at every site; the log of the scale goes along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Largest chance of a change between visited sites.
MOST_CHANGE = 0.99


@dataclass
class Painting:
    """Posterior of one haplotype: sites visited, topology[s, n] up to exp(log_scale[s])."""

    sites: np.ndarray
    topology: np.ndarray
    log_scale: np.ndarray


def visited(derived: np.ndarray) -> np.ndarray:
    """Derived sites of a haplotype, with the first and the last of the window."""
    at = np.flatnonzero(derived)
    return np.unique(np.concatenate([[0], at, [len(derived) - 1]])).astype(int) if len(derived) else at


def _steps(r: np.ndarray, sites: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance, log of staying) between successive visited sites."""
    run = np.concatenate([[0.0], np.cumsum(r)])
    total = run[sites[1:]] - run[sites[:-1]]
    chance = np.minimum(1 - np.exp(-total), MOST_CHANGE)
    return chance, np.maximum(-total, np.log(1 - MOST_CHANGE))


def paint(haps: np.ndarray, r: np.ndarray, k: int, theta: float, every_site: bool = False) -> Painting:
    """haps[site, haplotype] of 0 and 1, r[site] the step to the next site. every_site also visits ancestral sites."""
    n = haps.shape[1]
    sites = np.arange(len(haps)) if every_site else visited(haps[:, k])
    own = haps[sites, k][:, None]
    other = haps[sites]
    if every_site:
        emit = np.where(own == other, 1 - theta, theta)
    else:
        emit = np.where((own == 1) & (other == 0), theta, 1 - theta)
    emit = emit.astype(float)
    chance, stay = _steps(r, sites)
    count = len(sites)
    alpha, beta = np.zeros((count, n)), np.zeros((count, n))
    la, lb = np.zeros(count), np.zeros(count)
    a = emit[0] / (n - 1)
    a[k] = 0
    for s in range(count):
        if s:
            p = chance[s - 1]
            a = ((1 - p) * a + a.sum() * p / (n - 1)) * emit[s]
            a[k] = 0
            la[s] = la[s - 1]
        total = a.sum()
        a = a / total
        la[s] += np.log(total)
        alpha[s] = a
    b = np.ones(n)
    b[k] = 0
    beta[-1] = b
    for s in range(count - 2, -1, -1):
        p = chance[s]
        x = b * emit[s + 1]
        x[k] = 0
        b = (1 - p) * x + p * x.sum() / (n - 1)
        b[k] = 0
        total = b.sum()
        b = b / total
        lb[s] = lb[s + 1] + np.log(total)
        beta[s] = b
    del stay
    # constants that all haplotypes share drop out: log(n - 1) and one log(1 - theta) for each visited site
    shared = np.log(n - 1) - count * np.log(1 - theta)
    return Painting(sites, alpha * beta, la + lb + shared)


def stepping_stones(haps: np.ndarray, r: np.ndarray, k: int, theta: float, bounds: list[int]) -> list[Painting]:
    """The painting cut at window bounds: each part has the visited sites in [lo, hi) and the neighbours to both sides."""
    whole = paint(haps, r, k, theta)
    out = []
    for lo, hi in zip(bounds, [*bounds[1:], len(haps)], strict=True):
        first = max(0, int(np.searchsorted(whole.sites, lo, "right")) - 1)
        last = min(len(whole.sites), int(np.searchsorted(whole.sites, hi, "left")) + 1)
        out.append(Painting(whole.sites[first:last], whole.topology[first:last], whole.log_scale[first:last]))
    return out


def row(p: Painting, site: int, rpos: np.ndarray, k: int) -> np.ndarray:
    """Distances -log(posterior) of haplotype k to all others at a site, the least of them 0.

    Between visited sites posteriors are interpolated by genetic position, halves where positions are equal.
    """
    j = int(np.searchsorted(p.sites, site, "right")) - 1
    with np.errstate(divide="ignore"):
        if j >= 0 and (p.sites[j] == site or j + 1 == len(p.sites)):
            d = -(np.log(p.topology[j]) + p.log_scale[j])
        else:
            j = max(j, 0)
            a, b = p.sites[j], p.sites[j + 1]
            span = rpos[b] - rpos[a]
            w = (rpos[site] - rpos[a]) / span if span > 0 else 0.5
            top = max(p.log_scale[j], p.log_scale[j + 1])
            mix = (1 - w) * p.topology[j] * np.exp(p.log_scale[j] - top) + w * p.topology[j + 1] * np.exp(p.log_scale[j + 1] - top)
            d = -(np.log(mix) + top)
    d[k] = np.inf
    finite = d[np.isfinite(d)]
    low = finite.min() if len(finite) else 0.0
    d = np.where(np.isfinite(d), d - low, (finite.max() - low if len(finite) else 0.0) + 700.0)
    d[k] = 0.0
    return d


def distances(paintings: list[Painting], site: int, rpos: np.ndarray) -> np.ndarray:
    """The asymmetric distance matrix at a site."""
    return np.stack([row(p, site, rpos, k) for k, p in enumerate(paintings)])
