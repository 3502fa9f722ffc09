"""Line dedup and near duplicates against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from repeatloom.llm import common
from repeatloom.llm import near_dedup as N
from repeatloom.llm.graph import connected_components
from repeatloom.llm.line_dedup import drop_boilerplate

DOCS = "doc_id long, text string, source string"


def brute_lines(rows, ratio, least):
    pages = Counter(r[2] for r in rows)
    seen = Counter((r[2], x) for r in rows if r[1] is not None for x in {y.strip(" ") for y in r[1].split("\n")} if x)
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, text, source in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if (source, x.strip(" ")) not in bad]
        out.append((i, "\n".join(kept), len(lines) - len(kept)))
    return out


def test_line_dedup(spark):
    r = random.Random(1)
    rows = []
    for k in range(120):
        lines = [f"own {k} {j}" for j in range(r.randint(0, 4))] + [x for x in ("Accept all", " Menu", "", "Accept all") if r.random() < 0.4]
        r.shuffle(lines)
        rows.append((k, "\n".join(lines), r.choice(["a", "a", "b", None])))
    rows += [(200, None, "a"), (201, "", "a"), (201, "", "a"), (None, "Accept all", "a"), (202, "Accept all", "rare"), (203, "\n\n", None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as _drop", "2 as n_dropped", "3 as _HOST")
    got = drop_boilerplate(df, 0.2, 5)
    assert got.columns == ["doc_id", "text", "source", "_drop", "_HOST", "n_dropped"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((x.doc_id, x.text, x.n_dropped) for x in got.collect()), key=key) == sorted(brute_lines(rows, 0.2, 5), key=key)
    assert drop_boilerplate(df.limit(0)).count() == 0


def brute_components(rows, width, percent=80):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 1 << 60), 1 << 60 if i is None else i)
    ids = [None if least[find(k)] == 1 << 60 else least[find(k)] for k in range(len(rows))]
    return sorted(((i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, ids)), key=str)


def corpus(r, groups, size, edits):
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(1, size)):
            copy = list(base)
            for _ in range(r.randint(0, edits)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(" ".join(copy))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, groups, size, edits", [(1, 25, 12, 4), (2, 2, 150, 5)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, groups, size, edits):
    monkeypatch.setattr(N, "SMALL", 16)  # the second case has buckets beyond it
    monkeypatch.setattr(N, "BLOCK", 24)
    monkeypatch.setattr(N, "SIGNED", 40)
    monkeypatch.setattr(N, "BLOCK_BYTES", 20_000)
    rows = corpus(random.Random(seed), groups, size, edits)
    n = len(rows)
    rows += [(n, ""), (n + 1, None), (n + 2, "  \n"), (n + 3, "two words"), (n + 4, "TWO\twords"), (n + 5, rows[0][1].upper()), (n + 6, "x " * 30_000)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_components(rows, 4)


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"t{k}" for k in range(40))
    rows = [(5, long), (5, long), (3, long), (None, long), (None, "alone here now then"), (7, None)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, node int")
    got = sorted((tuple(x) for x in N.near_duplicates(df, width=4).collect()), key=str)
    assert got == sorted([(5, 37, 3, False), (5, 37, 3, False), (3, 37, 3, True), (None, 37, 3, False), (None, 1, None, True), (7, 0, 7, True)], key=str)
    assert N.near_duplicates(df.limit(0)).collect() == []


def test_one_text_of_each_node_is_compared(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_FILTER_BITS", 1)  # every document is let through
    made = {}
    monkeypatch.setattr(N, "cut", lambda df, name: made.setdefault(name, common.cut(df, name)))
    long = [" ".join(f"{w}{k}" for k in range(60)) for w in "ab"]
    rows = [(9 - k, long[0] + " end" * (k % 2)) for k in range(8)] + [(20, long[1]), (None, long[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(x) for x in N.near_duplicates(df, width=4).collect()), key=str)
    assert got == brute_components(rows, 4)
    assert made["texts"].count() == 2  # of two nodes, whichever copies a partition has


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], r.integers(0, 2**63, 100, dtype=np.uint64)])
    same = (N.signature(np.unique(a)) == N.signature(np.unique(b))).mean()
    assert abs(same - 900 / 1100) < 0.12


def test_connected_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)] + [(200, 200 + k) for k in range(1, 50)] + [(7, 7), (1, 0)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    up = {v: v for e in edges for v in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: find(v) for v in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
