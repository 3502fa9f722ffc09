import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repeatloom.kernels import alleles as A


def test_haplotypes_and_mixture():
    x = np.r_[np.full(10, 30.0), np.full(8, 90.0)]
    tags = np.r_[np.full(10, 1), np.full(8, 2)]
    a = A.assign(x, tags)
    assert a.method == "HP" and [z.median for z in a.alleles] == [30, 90] and a.labels.tolist() == [0] * 10 + [1] * 8
    b = A.assign(x, np.zeros(18, int))
    assert b.method == "GMM" and b.labels.tolist() == a.labels.tolist()


def test_order_is_by_size_whatever_the_tag():
    a = A.assign([90.0] * 5 + [30.0] * 5, [1] * 5 + [2] * 5)
    assert [(z.median, z.hp) for z in a.alleles] == [(30, 2), (90, 1)] and a.labels.tolist() == [1] * 5 + [0] * 5


def test_untagged_reads_join_near_haplotypes_only():
    a = A.assign([30.0] * 5 + [90.0] * 5 + [31, 60], [1] * 5 + [2] * 5 + [0, 0])
    assert a.method == "HP" and a.labels[-2:].tolist() == [0, -1]


def test_tags_that_miss_an_allele():
    a = A.assign([30.0] * 5 + [30.0] * 5 + [90.0] * 9, [1] * 5 + [2] * 5 + [0] * 9)
    assert a.method == "GMM" and len(a.notes) == 1 and [z.median for z in a.alleles] == [30, 90]


def test_haploid_empty_and_few_tags():
    assert A.assign([], []).method == "none"
    assert A.assign([5.0, 6, 7], [1, 1, 1], ploidy=1).method == "HP-haploid"
    assert A.assign([5.0, 6, 7], [0, 0, 0], ploidy=1).method == "GMM"
    assert len(A.assign([5.0] * 4, [1, 0, 0, 0]).notes) == 1


def test_minor_modes_fold_or_stay():
    x = [20.0] * 20 + [60.0] * 15 + [100.0] * 8
    folded, kept = A.assign(x, [0] * 43), A.assign(x, [0] * 43, mosaic=True)
    assert [z.minor for z in folded.alleles] == [False, False] and folded.labels.min() == 0 and folded.notes
    assert [(z.median, z.minor) for z in kept.alleles] == [(20, False), (60, False), (100, True)]


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.integers(1, 120), st.sampled_from([0, 1, 2])), min_size=1, max_size=40))
def test_cells_give_what_reads_give(reads):
    """Counted cells and single reads are assigned alike."""
    x, hp = np.array([r[0] for r in reads], float), np.array([r[1] for r in reads])
    cells = sorted(set(zip(x, hp)))
    n = [sum((x == v) & (hp == h)) for v, h in cells]
    a = A.assign(x, hp)
    b = A.assign([c[0] for c in cells], [c[1] for c in cells], n)
    assert a.method == b.method and [z.median for z in a.alleles] == pytest.approx([z.median for z in b.alleles])
    of = dict(zip(cells, b.labels))
    assert [of[c] for c in zip(x, hp)] == a.labels.tolist()


@given(st.lists(st.integers(0, 50), min_size=1, max_size=30), st.floats(0, 1))
def test_quantiles_equal_numpy(values, q):
    v, n = np.unique(values, return_counts=True)
    assert A.quantile(v.astype(float), n, q) == pytest.approx(np.quantile(values, q))
    assert A.median(v.astype(float), n) == np.median(values)


def test_mixture_fit_recovers_components():
    r = np.random.default_rng(3)
    x = np.r_[r.normal(20, 1, 300), r.normal(50, 2, 200)]
    fit = A.fit_mixture(x, np.ones(500, int), 2)
    assert sorted(fit.mu) == pytest.approx([20, 50], abs=0.5) and sorted(fit.w) == pytest.approx([0.4, 0.6], abs=0.02)
    assert fit.bic < A.fit_mixture(x, np.ones(500, int), 1).bic


def plain_mixture(reads, k):
    """Expectation maximisation read by read, in plain loops."""
    import math

    n, mean = len(reads), sum(reads) / len(reads)
    start = sorted(reads)

    def at(q):
        place = q * (n - 1)
        low = math.floor(place)
        return start[low] + (place - low) * (start[min(low + 1, n - 1)] - start[low])

    mu = [at((j + 0.5) / k) for j in range(k)]
    var = [max(sum((x - mean) ** 2 for x in reads) / n, A.QUANT_VAR)] * k
    w, before = [1 / k] * k, -math.inf
    for _ in range(A.ITERATIONS):
        shares, now = [], 0.0
        for x in reads:
            p = [w[j] * math.exp(-((x - mu[j]) ** 2) / (2 * var[j])) / math.sqrt(2 * math.pi * var[j]) for j in range(k)]
            now += math.log(sum(p))
            shares.append([v / sum(p) for v in p])
        for j in range(k):
            nk = sum(s[j] for s in shares) + A.EPSILON
            w[j], mu[j] = nk / n, sum(s[j] * x for s, x in zip(shares, reads)) / nk
            least = max(A.QUANT_VAR, (A.REL_SD * max(mu[j], 1.0)) ** 2)
            var[j] = max(sum(s[j] * (x - mu[j]) ** 2 for s, x in zip(shares, reads)) / nk, least)
        if now - before < A.GAIN:
            break
        before = now
    return mu, [math.sqrt(v) for v in var], w, now, -2 * now + (3 * k - 1) * math.log(max(n, 2))


def test_batched_fits_equal_plain_loops():
    """Means, deviations, weights, likelihood and criterion within 1e-6, fitted in one batch."""
    r = np.random.default_rng(11)
    for k in (1, 2, 3, 4):
        cases = [np.rint(np.concatenate([r.normal(c, r.uniform(0.3, 2), r.integers(2, 9)) for c in np.cumsum(r.uniform(4, 12, r.integers(1, 4))) + 5])) for _ in range(25)]
        cases = [c for c in cases if len(c) >= 3 * k]
        cells = [np.unique(c, return_counts=True) for c in cases]
        width = max(len(v) for v, _ in cells)
        x, n = np.zeros((len(cells), width)), np.zeros((len(cells), width), int)
        for i, (v, c) in enumerate(cells):
            x[i, : len(v)], n[i, : len(v)] = v, c
        for fit, reads in zip(A.fit_mixtures(x, n, k), cases):
            mu, sd, w, ll, bic = plain_mixture(reads.tolist(), k)
            for got, want in ((fit.mu, mu), (fit.sd, sd), (fit.w, w), ([fit.ll], [ll]), ([fit.bic], [bic])):
                assert np.allclose(got, want, rtol=1e-6, atol=1e-9)
