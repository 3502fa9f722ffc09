import random

import pytest

from repeatloom.kernels import basemods as B
from repeatloom.kernels import consensus as C
from repeatloom.kernels.units import Motifs

LEFT, RIGHT = "TTACT", "TTGACAT"


def reads_of(m, segments, window, units):
    runs = [m.decompose(s, window, window[1] - window[0]) for s in segments]
    return [C.Read(s[r.start : r.end], r, units) for s, r in zip(segments, runs)]


def test_votes_restore_the_tract():
    m, truth = Motifs(3, ("CAG",)), "CAG" * 10
    edited = [truth[:7] + "T" + truth[8:], truth[:10] + truth[11:], truth[:17] + "T" + truth[18:], truth[:13] + "T" + truth[13:], truth[:19] + "T" + truth[20:]]
    reads = reads_of(m, [LEFT + t + RIGHT for t in edited], (5, 35), 10)
    assert C.consensus(reads, m, 0) == truth
    assert C.consensus(reads[:2], m, 0) is None


def test_tokens_are_cut_in_one_phase():
    m = Motifs(3, ("CAG",))
    (read,) = reads_of(m, [LEFT + "CAG" * 3 + "CA" + "CAG" * 4 + RIGHT], (5, 28), 8)
    ballot = C.Ballot(m, read).cut(0)
    assert ballot.tokens == ["CAG", "CAG", "CAG", "CAC", "AG", "CAG", "CAGC"] and ballot.framed == (True, False)
    assert "".join(ballot.tokens) == read.seq
    turned = C.Ballot(m, read).cut(1)
    assert "".join(turned.tokens) == read.seq and turned.tokens[1] == "AGC"


@pytest.mark.parametrize("units, found, short", [(30, 30, 0), (30, 27, 0), (30, 26, 1), (5, 4, 0), (5, 3, 1)])
def test_shortfall(units, found, short):
    assert C.shortfall(units, found) == short


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_alignment_is_a_shortest_edit():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("ACG") for _ in range(r.randint(0, 9))) for _ in range(2))
        at, before = C.align(a, b)
        assert len(at) == len(a) and len(before) == len(a) + 1
        assert "".join(x for pair in zip(before, [*at, ""]) for x in pair).replace("-", "") == b
        edits = sum(map(len, before)) + sum(x != y for x, y in zip(at, a))
        assert edits == edit_distance(a, b) == C.distances(a, b)[-1, -1]


def test_settled_places():
    assert C.settle(["ACGT", "ACGA", "ACG"]) == "ACGT"  # the first of equally central tokens
    assert C.settle(["AACC", "AATCC", "AAGCC"]) == "AACC"  # no insertion has most votes but none
    assert C.settle(["CAG", "CTG", "CCG"]) == "CAG" and C.settle(["CAG"]) == "CAG"
    assert C.units_in(4, 3) == 1 and C.units_in(5, 3) == 2 and C.units_in(1, 3) == 0


def test_weights_are_repeated_reads():
    r, m = random.Random(2), Motifs(3, ("CAG",), interruption=("CAA",))
    for _ in range(60):
        made = []
        for _ in range(r.randint(2, 5)):
            tract = list("CAG" * 6 + "CAA" + "CAG" * 5)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(tract))
                tract[k : k + 1] = r.choice(["", "T", "GT", tract[k]])
            made.append(LEFT + "".join(tract) + RIGHT)
        reads = reads_of(m, made, (5, 41), 12)
        weights = [r.randint(1, 3) for _ in reads]
        once = C.consensus([C.Read(x.seq, x.run, x.units, w) for x, w in zip(reads, weights)], m, 0)
        first = [sum(weights[:k]) for k in range(len(reads))]
        assert once == C.consensus([x for x, w in zip(reads, weights) for _ in range(w)], m, first[0])


SEQ = "ACGCGTCCA"


def sites(*args):
    return [(x[2], x[3]) for x in B.modified_sites(SEQ, *args)]


def test_tags_forward_and_reverse():
    assert sites(False, "C+m,0,1;", [10, 200]) == [(1, 10), (6, 200)]
    assert sorted(sites(True, "C+m,0,0;", [10, 200])) == [(2, 200), (4, 10)]
    assert sites(False, "C+m,0,1;", None) == [(1, -1), (6, -1)]
    assert B.cytosine_sites(SEQ, False, "C+mh,0;", [128, 64]) == [(1, 128.5 / 256, 64.5 / 256)]
    assert B.cytosine_sites(SEQ, False, "C+27551?,0;A+a,0;", [128, 9]) == [(1, 128.5 / 256, 0.0)]
    assert B.cytosine_sites(SEQ, False, None, None) == []


@pytest.mark.parametrize(
    "reverse, mm, ml, mn",
    [(True, "C+m,0,1;", [1, 2], None), (False, "C+m,9;", [1], None), (False, "C+m,0", [1], None), (False, "X+m,0;", [1], None), (False, "C*m,0;", [1], None), (False, "C+m,0;", [], None), (False, "C+m,0;", [1, 2], None), (False, "C+m,0;", [1], 5), (False, "C+,0;", [1], None)],
)
def test_tags_that_do_not_fit_are_refused(reverse, mm, ml, mn):
    with pytest.raises(B.Refused):
        B.modified_sites(SEQ, reverse, mm, ml, mn)
    assert B.cytosine_sites(SEQ, reverse, mm, ml, mn) == []
