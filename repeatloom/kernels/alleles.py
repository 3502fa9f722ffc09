"""Alleles of a locus from its reads' unit counts.

An assignment depends on a read's count and haplotype tag only, so the kernel works on
cells (count, tag, number of reads): a deep locus is as small as a shallow one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ..schema import QUANT_VAR, REL_SD, SEP_K, SEP_MIN

ITERATIONS, GAIN, EPSILON, BIC_GAIN = 300, 1e-6, 1e-9, 1e-9


@dataclass
class Mixture:
    mu: np.ndarray
    sd: np.ndarray
    w: np.ndarray
    ll: float
    bic: float


@dataclass
class Allele:
    median: float
    hp: int | None = None
    minor: bool = False


@dataclass
class Assignment:
    labels: np.ndarray  # of cells; -1 for none
    alleles: list[Allele]
    method: str
    notes: list[str] = field(default_factory=list)


def quantile(x: np.ndarray, n: np.ndarray, q) -> np.ndarray:
    """Linear interpolation between order statistics of values ``x`` that occur ``n`` times."""
    order = np.argsort(x, kind="stable")
    x, top = x[order], np.cumsum(n[order])
    at = np.asarray(q, float) * (top[-1] - 1)
    low = np.floor(at)
    a, b = (x[np.searchsorted(top, k, side="right")] for k in (low, np.minimum(low + 1, top[-1] - 1)))
    part = at - low
    return np.where(part < 0.5, a + (b - a) * part, b - (b - a) * (1 - part))


def median(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    top = np.cumsum(n[order])
    a, b = (x[order][np.searchsorted(top, k, side="right")] for k in ((top[-1] - 1) // 2, top[-1] // 2))
    return float((a + b) / 2)


def tolerance(centre: float) -> float:
    return max(2.0, 0.10 * centre)


def least_variance(mu):
    return np.maximum(QUANT_VAR, (REL_SD * np.maximum(mu, 1.0)) ** 2)


def resolution(centre: float) -> float:
    return max(SEP_MIN, SEP_K * math.sqrt(float(least_variance(centre))))


def fit_mixtures(x: np.ndarray, n: np.ndarray, k: int) -> list[Mixture]:
    """One-dimensional Gaussian mixtures of ``k`` components by expectation maximisation,
    one for each row of values ``x`` that occur ``n`` times; a count of 0 is padding."""
    total = n.sum(1)
    mean = (x * n).sum(1) / total
    points = (np.arange(k) + 0.5) / k
    mu = np.stack([quantile(a[c > 0], c[c > 0], points) for a, c in zip(x, n)])
    spread = (n * (x - mean[:, None]) ** 2).sum(1) / total
    var = np.repeat(np.maximum(spread, QUANT_VAR)[:, None], k, 1)
    w = np.full((len(x), k), 1.0 / k)
    ll = np.full(len(x), -np.inf)
    live = np.arange(len(x))
    for _ in range(ITERATIONS):
        xs, ns, m, v = x[live], n[live], mu[live], var[live]
        logp = (np.log(w[live]) - 0.5 * np.log(2 * np.pi * v))[:, None, :] - (xs[:, :, None] - m[:, None, :]) ** 2 / (2 * v)[:, None, :]
        top = logp.max(2)
        lse = top + np.log(np.exp(logp - top[:, :, None]).sum(2))
        share = np.exp(logp - lse[:, :, None]) * ns[:, :, None]
        now = (lse * ns).sum(1)
        nk = share.sum(1) + EPSILON
        w[live], m = nk / total[live][:, None], (share * xs[:, :, None]).sum(1) / nk
        mu[live] = m
        var[live] = np.maximum((share * (xs[:, :, None] - m[:, None, :]) ** 2).sum(1) / nk, least_variance(m))
        gain = now - ll[live]
        ll[live] = now
        live = live[gain >= GAIN]
        if not len(live):
            break
    bic = -2 * ll + (3 * k - 1) * np.log(np.maximum(total, 2))
    return [Mixture(mu[i], np.sqrt(var[i]), w[i], float(ll[i]), float(bic[i])) for i in range(len(x))]


def fit_mixture(x: np.ndarray, n: np.ndarray, k: int) -> Mixture:
    return fit_mixtures(np.asarray(x, float)[None], np.asarray(n)[None], k)[0]


def components_of(cells: list[tuple[np.ndarray, np.ndarray]], most: int) -> list[np.ndarray]:
    """For each set of cells, the centres of the mixture of least BIC; components that cannot
    be told apart are merged into the heavier."""
    width = max((len(x) for x, _ in cells), default=0)
    padded = np.zeros((2, len(cells), width))
    for i, (x, n) in enumerate(cells):
        padded[0, i, : len(x)], padded[1, i, : len(x)] = x, n
    total, best = padded[1].sum(1), [None] * len(cells)
    for k in range(1, most + 1):
        enough = np.flatnonzero(total >= 3 * k)
        if not len(enough):
            break
        for i, fit in zip(enough, fit_mixtures(padded[0, enough], padded[1, enough], k)):
            if best[i] is None or fit.bic < best[i].bic - BIC_GAIN:
                best[i] = fit
    return [np.array([median(*c)]) if fit is None else _resolved(fit) for c, fit in zip(cells, best)]


def _resolved(fit: Mixture) -> np.ndarray:
    kept: list[int] = []
    for j in np.argsort(fit.mu, kind="stable"):
        if kept and abs(fit.mu[j] - fit.mu[kept[-1]]) < max(SEP_MIN, SEP_K * max(fit.sd[j], fit.sd[kept[-1]])):
            if fit.w[j] > fit.w[kept[-1]]:
                kept[-1] = j
        else:
            kept.append(j)
    return fit.mu[kept]


def components(x: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    return components_of([(x, n)], most)[0]


def nearest(x: np.ndarray, centres) -> np.ndarray:
    return np.abs(x[:, None] - np.asarray(centres)).argmin(1)


def prune(x: np.ndarray, n: np.ndarray, centres: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Drop the smallest cluster until none is below ``least`` reads."""
    labels = nearest(x, centres)
    while len(centres) > 1:
        sizes = np.bincount(labels, n, len(centres))
        k = int(sizes.argmin())
        if sizes[k] >= least:
            break
        centres = np.delete(centres, k)
        labels = nearest(x, centres)
    return centres, labels


def _tags_miss_one(x, n, hp, centres: list[float], need: int, mixture) -> bool:
    """Do untagged reads show an allele that neither haplotype describes?"""
    untagged = ~np.isin(hp, (1, 2))
    far = np.min([np.abs(x - c) - resolution(c) for c in centres], axis=0) > 0
    if not untagged.any() or n[untagged & far].sum() < need:
        return False
    left, labels = prune(x, n, mixture(x, n, 4), need)
    meds = [median(x[labels == k], n[labels == k]) for k in range(len(left)) if (labels == k).any()]
    return len(meds) >= 2 and max(meds) - min(meds) > resolution(max(meds))


def assign(values, hps, counts=None, ploidy: int = 2, mosaic: bool = False, min_support: int = 3, min_frac: float = 0.10, use_hp: bool = True, mixture=components) -> Assignment:
    """Alleles of cells; without ``counts`` each value is one read. mixture: gives the centres."""
    x, hp = np.asarray(values, float), np.asarray(hps, int)
    n = np.ones(len(x), int) if counts is None else np.asarray(counts, int)
    if not len(x):
        return Assignment(np.zeros(0, int), [], "none")
    notes: list[str] = []
    need = max(min_support, math.ceil(min_frac * n.sum()))
    zero = np.zeros(len(x), int)
    if use_hp:
        reads = {h: int(n[hp == h].sum()) for h in (1, 2)}
        good = [h for h in (1, 2) if reads[h] >= min_support and reads[h] > 0]
        if ploidy == 2 and len(good) == 2:
            centres = [median(x[hp == h], n[hp == h]) for h in good]
            if _tags_miss_one(x, n, hp, centres, need, mixture):
                notes.append("tags describe one allele, reads show two: mixture model used")
            else:
                near = nearest(x, centres)
                close = np.abs(x - np.take(centres, near)) <= np.array([tolerance(c) for c in centres])[near]
                labels = np.where(hp == 1, 0, np.where(hp == 2, 1, np.where(close, near, -1)))
                return _ordered(labels, [Allele(c, h) for c, h in zip(centres, good)], "HP", notes)
        if ploidy == 1 and good:
            if len(good) == 2:
                notes.append("two haplotype tags at a haploid locus: merged")
            return Assignment(zero, [Allele(median(x, n))], "HP-haploid", notes)
        if not good and any(reads.values()):
            notes.append("haplotype tags below the least support: mixture model used")
    if ploidy == 1:
        return Assignment(zero, [Allele(median(x, n))], "GMM", notes)
    _, first = prune(x, n, mixture(x, n, ploidy + 2), need)
    groups = sorted((first == k for k in np.unique(first)), key=lambda m: (-n[m].sum(), median(x[m], n[m])))
    labels = np.full(len(x), -1)
    kept = groups if mosaic else groups[:ploidy]
    for k, m in enumerate(kept):
        labels[m] = k
    alleles = [Allele(median(x[m], n[m]), None, k >= ploidy) for k, m in enumerate(kept)]
    extra = len(groups) - len(kept)
    if extra:
        rest = labels < 0
        labels[rest] = nearest(x[rest], [a.median for a in alleles])
        alleles = [Allele(median(x[labels == k], n[labels == k])) for k in range(len(alleles))]
        notes.append(f"{extra} minor mode(s) folded into alleles")
    return _ordered(labels, alleles, "GMM", notes)


def _ordered(labels: np.ndarray, alleles: list[Allele], method: str, notes: list[str]) -> Assignment:
    """Alleles by size, minor modes last, labels renumbered."""
    order = sorted(range(len(alleles)), key=lambda k: (alleles[k].minor, alleles[k].median))
    rank = np.empty(len(order) + 1, int)
    rank[-1] = -1
    rank[order] = np.arange(len(order))
    return Assignment(rank[labels], [alleles[k] for k in order], method, notes)


class _Wanted(Exception):
    """A locus whose mixture is not fitted yet; holds the number of components."""


def assign_many(loci: list[dict]) -> list[Assignment]:
    """``assign`` of many loci (its arguments, a dict each): their mixtures are fitted together."""
    out: list[Assignment | None] = [None] * len(loci)
    waiting: dict[int, list[int]] = {}

    def later(x, n, most):
        raise _Wanted(most)

    for i, arguments in enumerate(loci):
        try:
            out[i] = assign(**arguments, mixture=later)
        except _Wanted as wanted:
            waiting.setdefault(wanted.args[0], []).append(i)
    for most, some in waiting.items():
        cells = [(np.asarray(loci[i]["values"], float), np.asarray(loci[i]["counts"], int)) for i in some]
        for i, centres in zip(some, components_of(cells, most)):
            out[i] = assign(**loci[i], mixture=lambda x, n, k, c=centres: c)
    return out
