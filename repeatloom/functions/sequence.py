"""Motifs, CIGARs and sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CIGAR operations in the alignment format's order, M I D N S H P = X.
REF_OPS, QUERY_OPS, SOFT, HARD = (0, 2, 3, 7, 8), (0, 1, 4, 7, 8), 4, 5


def revcomp(s: Column) -> Column:
    return F.translate(F.reverse(F.upper(s)), "ACGT", "TGCA")


def on_strand(s: Column, strand: Column) -> Column:
    return F.when(strand == "+", F.upper(s)).otherwise(revcomp(s))


def rotations(motif: Column) -> Column:
    """Distinct rotations, the motif first."""
    turn = lambda k: F.concat(F.substring(motif, k + 1, F.length(motif)), F.substring(motif, F.lit(1), k))
    return F.when(F.length(motif) > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.length(motif) - 1), turn)))


def span(cigar: Column, ops: tuple[int, ...]) -> Column:
    """Bases that the operations ``ops`` of a CIGAR consume."""
    used = F.filter(cigar, lambda c: c["op"].isin(*ops))
    return F.aggregate(used, F.lit(0).cast("long"), lambda a, c: a + c["len"])


def reference_end(pos: Column, cigar: Column) -> Column:
    return pos + F.greatest(span(cigar, REF_OPS), F.lit(1).cast("long"))


def read_length(cigar: Column) -> Column:
    return span(cigar, (*QUERY_OPS, HARD))


def _clip(item: Column) -> Column:
    return F.when(item["op"].isin(SOFT, HARD), item["len"]).otherwise(0)


def left_clip(cigar: Column) -> Column:
    return F.coalesce(_clip(F.try_element_at(cigar, F.lit(1))), F.lit(0))


def right_clip(cigar: Column) -> Column:
    return F.coalesce(_clip(F.try_element_at(cigar, F.lit(-1))), F.lit(0))


def soft_run(cigar: Column, from_right: bool = False) -> Column:
    """Soft-clipped bases at an end, behind hard clips."""
    order = F.reverse(cigar) if from_right else cigar
    inner = F.filter(order, lambda c, i: c["op"] != HARD)
    first = F.try_element_at(inner, F.lit(1))
    return F.coalesce(F.when(first["op"] == SOFT, first["len"]), F.lit(0))


def lag_matches(s: Column, lag: Column) -> Column:
    """Positions whose base equals that ``lag`` further on."""
    n = F.length(s) - lag
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(1)) == F.substring(s, i + lag, F.lit(1)))
    return F.when(n > 0, F.size(same)).otherwise(0)


def run_lengths(s: Column) -> Column:
    """Run-length code of a string: an array of struct(label, n)."""
    kind = "array<struct<label:string,n:int>>"

    def step(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(c.alias("label"), (last["n"] + 1).alias("n"))))
        fresh = F.concat(acc, F.array(F.struct(c.alias("label"), F.lit(1).alias("n"))))
        return F.when(last["label"] == c, longer).otherwise(fresh).cast(kind)

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(chars, F.expr(f"cast(array() as {kind})"), step)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals share a base."""
    return (a_start < b_end) & (a_end > b_start)
