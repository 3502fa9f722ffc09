"""Where a read's alignment puts a locus: positions by CIGAR blocks, never by bases."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

# Operations of the alignment format, M I D N S H P = X.
ALIGNED, INSERTED, REF_ONLY, SOFT, HARD = (0, 7, 8), 1, (2, 3), 4, 5

Span = tuple[int, int]


@dataclass(frozen=True)
class Alignment:
    """Aligned blocks of a read: query start, reference start and length of each."""

    pos: int
    cigar: tuple[Span, ...]
    reverse: bool

    def __post_init__(self) -> None:
        q, r, blocks, inserted = 0, self.pos, [], []
        for op, n in self.cigar:
            if op in ALIGNED:
                blocks.append((q, r, n))
                q, r = q + n, r + n
            elif op == INSERTED:
                inserted.append((r, q, q + n))
                q += n
            elif op == SOFT:
                q += n
            elif op in REF_ONLY:
                r += n
        object.__setattr__(self, "blocks", blocks)
        object.__setattr__(self, "inserted", inserted)
        object.__setattr__(self, "ref_end", max(r, self.pos + 1))
        object.__setattr__(self, "_starts", [b[1] for b in blocks])
        object.__setattr__(self, "_ends", [b[1] + b[2] for b in blocks])

    def at_or_after(self, ref: int) -> int | None:
        """Query base aligned to ``ref`` or the next aligned position."""
        k = bisect_right(self._ends, ref)
        if k == len(self.blocks):
            return None
        q, r, _ = self.blocks[k]
        return q + max(0, ref - r)

    def before(self, ref: int) -> int | None:
        """One past the last query base aligned before ``ref``."""
        k = bisect_left(self._starts, ref) - 1
        if k < 0:
            return None
        q, r, n = self.blocks[k]
        return q + min(n, ref - r)

    def window(self, start: int, end: int) -> Span | None:
        a, b = self.at_or_after(start), self.before(end)
        return (a, b) if a is not None and b is not None and a < b else None

    def _clip(self, k: int) -> Span:
        op, n = self.cigar[k] if self.cigar else (0, 0)
        return (op, n) if op in (SOFT, HARD) else (0, 0)

    @property
    def clips(self) -> tuple[Span, Span]:
        """(operation, length) of the clips at both ends."""
        return self._clip(0), self._clip(-1)

    def query_edges(self) -> Span:
        """Query span without soft clips."""
        inner = [c for c in self.cigar if c[0] != HARD]
        total = sum(n for op, n in self.cigar if op in (*ALIGNED, INSERTED, SOFT))
        left = inner[0][1] if inner and inner[0][0] == SOFT else 0
        right = inner[-1][1] if inner and inner[-1][0] == SOFT else 0
        return left, total - right

    @property
    def read_length(self) -> int:
        return sum(n for op, n in self.cigar if op in (*ALIGNED, INSERTED, SOFT, HARD))

    def own_coordinate(self, q: int) -> int:
        """A query position in the read's own direction, hard clips counted."""
        (op, n), _ = self.clips
        p = q + (n if op == HARD else 0)
        return self.read_length - 1 - p if self.reverse else p


def period_flanks(reference: str, offset: int, start: int, end: int, unit_len: int, reach: int) -> Span:
    """Flank bases on each side of the tract that continue its period, at most ``reach``."""
    base = lambda x: reference[x - offset] if 0 <= x - offset < len(reference) else "N"

    def run(first: int, step: int) -> int:
        n = 0
        while n < reach:
            x = first + step * n
            if base(x) not in "ACGT" or base(x) != base(x - step * unit_len):
                break
            n += 1
        return n

    return run(start - 1, -1), run(end, 1)


def size_bounds(start: int, end: int, anchor: int, flank: int, period: Span) -> Span:
    """Reference bounds between which a spanning read's size is measured."""
    left, right = period
    lo, hi = start - anchor, end + anchor
    if 0 < anchor <= left:
        lo = min(lo, max(start - flank, start - left - 1))
    if 0 < anchor <= right:
        hi = max(hi, min(end + flank, end + right + 1))
    return lo, hi


@dataclass
class Observation:
    kind: str
    segment: str | None = None
    seg_left: int = 0
    size_bp: int | None = None
    edge: int | None = None
    window: Span | None = None


def _slice(seq: str, a: int, b: int) -> str:
    n = len(seq)
    return seq[min(max(a, 0), n) : min(max(b, 0), n)]


def observe(a: Alignment, seq: str | None, start: int, end: int, anchor: int, flank: int, min_clip: int, margin: int, period: Span = (0, 0), widen: bool = False) -> Observation | None:
    """What a record shows of the tract [start, end): spanning, a partial, or nothing.

    widen: a long motif, whose window takes in insertions among flank bases of its period.
    """
    left, right = a.pos <= start - flank, a.ref_end >= end + flank
    (left_op, left_clip), (right_op, right_clip) = a.clips
    if left and right:
        whole = a.window(start - anchor, end + anchor)
        if whole is None or seq is None:
            return None
        lo, hi = size_bounds(start, end, anchor, flank, period)
        ql, qr = a.window(lo, hi) or whole
        dl, dr = a.window(start - margin, end + margin) or whole
        segment = _slice(seq, dl, dr)
        reach = tuple(min(p, margin) for p in period) if widen else (0, 0)
        size = max(0, (qr - ql) - (start - lo) - (hi - end))
        return Observation("spanning", segment, dl, size, None, _tract(a, start, end, dl, len(segment), reach))
    if left and right_clip >= min_clip:
        q = a.at_or_after(start - anchor)
        if q is None:
            return None
        segment = _slice(seq, q, len(seq)) if right_op == SOFT and seq is not None else None
        window = None
        if segment is not None:
            at = a.at_or_after(start)
            if at is None:
                at = a.query_edges()[1] + max(0, start - a.ref_end)
            window = (max(0, min(len(segment), at - q)), len(segment))
        return Observation("left_partial", segment, q, None, a.own_coordinate(q), window)
    if right and left_clip >= min_clip:
        q = a.before(end + anchor)
        if q is None:
            return None
        segment = _slice(seq, 0, q) if left_op == SOFT and seq is not None else None
        window = None
        if segment is not None:
            at = a.before(end)
            if at is None:
                at = a.query_edges()[0] - max(0, a.pos - end)
            window = (0, max(0, min(len(segment), at)))
        return Observation("right_partial", segment, 0, None, a.own_coordinate(q), window)
    return None


def _tract(a: Alignment, start: int, end: int, seg_left: int, seg_len: int, reach: Span) -> Span | None:
    """The tract in the segment: from past the left flank's last base to the right flank's first."""
    q0, q1 = a.before(start), a.at_or_after(end)
    if q0 is None or q1 is None:
        return None
    for ref, i0, i1 in a.inserted if any(reach) else ():
        if start - reach[0] <= ref < start:
            q0 = min(q0, i0)
        elif end < ref <= end + reach[1]:
            q1 = max(q1, i1)
    lo, hi = max(0, q0 - seg_left), min(seg_len, q1 - seg_left)
    return (lo, hi) if lo < hi else None


def alignment(pos: int, cigar: Sequence, reverse: bool) -> Alignment:
    return Alignment(pos, tuple((c["op"], c["len"]) for c in cigar or ()), reverse)
