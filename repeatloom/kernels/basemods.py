"""Base-modification tags: positions and probabilities of modified cytosines.

A tag group names a base, a strand and one or more codes, then how many of that base to
skip before each modified one, counted from the read's own 5' end. Likelihood bytes
follow in the same order, interleaved where a group has several codes. A tag that does
not fit the sequence or its likelihoods is refused as a whole.
"""

from __future__ import annotations

import re

_GROUP = re.compile(r"([ACGTUN])([+-])([0-9]+|[A-Za-z]+)([.?]?)((?:,[0-9]+)*),?;")
_COMPLEMENT = str.maketrans("ACGTN", "TGCAN")
# Codes of methyl- and hydroxymethylcytosine.
METHYL, HYDROXY = frozenset(("m", "27551")), frozenset(("h", "76792"))
MAX_CODES, MAX_SKIP = 256, 2**31 - 1
UNKNOWN = -1


class Refused(ValueError):
    """The tag cannot be read."""


def parse(mm: str) -> list[tuple[str, list[str], list[int]]]:
    """(base, codes, skips) of each group."""
    groups, at = [], 0
    while at < len(mm):
        m = _GROUP.match(mm, at)
        if not m:
            raise Refused("malformed tag")
        codes = [m[3]] if m[3].isdigit() else list(m[3])
        skips = [int(x) for x in m[5].split(",")[1:]]
        if any(x > MAX_SKIP for x in skips):
            raise Refused("skip out of range")
        groups.append(("T" if m[1] == "U" else m[1], codes, skips))
        at = m.end()
    if sum(len(g[1]) for g in groups) >= MAX_CODES:
        raise Refused("too many codes")
    return groups


def modified_sites(seq: str, reverse: bool, mm: str | None, ml: list[int] | None, mn: int | None = None) -> list[tuple[str, str, int, int]]:
    """(base, code, position in ``seq``, likelihood byte or -1) in tag order."""
    if not mm:
        return []
    if mn is not None and seq and mn != len(seq):
        raise Refused("length differs from the tagged sequence's")
    out, used = [], 0
    for base, codes, skips in parse(mm):
        stored = base.translate(_COMPLEMENT) if reverse else base
        places = [k for k, c in enumerate(seq) if stored == "N" or c == stored]
        if reverse:
            places.reverse()
        at = -1
        for k, skip in enumerate(skips):
            at += skip + 1
            if at >= len(places):
                raise Refused("skips past the sequence")
            for j, code in enumerate(codes):
                n = used + k * len(codes) + j
                if ml is not None and n >= len(ml):
                    raise Refused("too few likelihoods")
                out.append((base, code, places[at], UNKNOWN if ml is None else ml[n]))
        used += len(skips) * len(codes)
    if ml is not None and used != len(ml):
        raise Refused("too many likelihoods")
    return out


def probability(byte: int) -> float:
    return (byte + 0.5) / 256.0


def cytosine_sites(seq: str, reverse: bool, mm: str | None, ml: list[int] | None, mn: int | None = None) -> list[tuple[int, float, float]]:
    """(position, p_m, p_h) of modified cytosines by position; none where the tag is refused."""
    try:
        found = modified_sites(seq, reverse, mm, ml, mn)
    except Refused:
        return []
    p: tuple[dict, dict] = ({}, {})
    for base, code, at, byte in found:
        if base == "C" and code in METHYL | HYDROXY:
            p[code in HYDROXY][at] = probability(byte)
    return [(q, p[0].get(q, 0.0), p[1].get(q, 0.0)) for q in sorted({*p[0], *p[1]})]
