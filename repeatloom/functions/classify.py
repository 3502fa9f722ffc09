"""Size classes, evidence and detectability as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def at_least(value: Column, bound: Column) -> Column:
    """A missing bound passes."""
    return bound.isNull() | (value >= bound)


def in_benign(units: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce(hi.isNotNull() & (units <= hi) & at_least(units, lo), F.lit(False))


def classify_bands(units: Column, bands: Column) -> Column:
    """The label of the first band that holds ``units``."""
    held = F.filter(bands, lambda b: units <= F.coalesce(b["upper"], F.lit(S.BAND_TOP)))
    return F.when(units.isNull(), F.lit(S.NO_CALL)).otherwise(F.coalesce(F.try_element_at(held, F.lit(1))["label"], F.lit(S.NO_CALL)))


def classify_thresholds(units: Column, bmin: Column, bmax: Column, imin: Column, imax: Column, pmin: Column, pmax: Column) -> Column:
    """Class by catalogue thresholds; a locus whose pathogenic range lies below the
    benign one is read downwards."""
    benign = in_benign(units, bmin, bmax)
    contraction = pmin.isNotNull() & pmax.isNotNull() & bmin.isNotNull() & (pmax < bmin)
    downwards = F.when(units <= pmax, S.PATHOGENIC).when(benign, S.BENIGN).otherwise(S.UNCERTAIN)
    upwards = (
        F.when(benign, S.BENIGN)
        .when(units.between(imin, imax), S.INTERMEDIATE)
        .when(units >= pmin, S.PATHOGENIC)
        .when(units <= bmax, S.BENIGN)
        .otherwise(S.UNCERTAIN)
    )
    return F.when(units.isNull(), S.NO_CALL).when(contraction, downwards).otherwise(upwards)


def classify(units: Column, bands: Column, *thresholds: Column) -> Column:
    """Bands, where a locus has any, before thresholds (bmin, bmax, imin, imax, pmin, pmax)."""
    has = bands.isNotNull() & (F.size(bands) > 0)
    return F.when(has, classify_bands(units, bands)).otherwise(classify_thresholds(units, *thresholds))


def size_units(total: Column, interruptions: Column, clinical: Column, counted: Column) -> Column:
    """Allele size; the clinical convention leaves interruptions out where they are not counted."""
    return F.when(clinical & ~counted, F.greatest(total - interruptions, F.lit(0.0))).otherwise(total)


def class_units(total: Column, benign_units: Column, pathogenic_units: Column, composition: Column) -> Column:
    """What is classified: pathogenic units where composition decides, else total less benign units."""
    return F.when(composition, pathogenic_units).otherwise(F.greatest(total - F.coalesce(benign_units, F.lit(0.0)), F.lit(0.0)))


def over_dispersed(median: Column, p95: Column, tail_up: Column, n: Column) -> Column:
    far = p95 > F.greatest(median * S.DISPERSION_SLACK, median + S.DISPERSION_FLOOR)
    return F.coalesce(far & (F.rint(tail_up * n) >= S.DISPERSION_READS), F.lit(False))


def evidence_state(bound: Column, support: Column, medians: Column, pmin: Column, n_partial: Column) -> Column:
    """Whether partial reads show more than the alleles explain. medians: array of alleles' medians."""
    explained = F.exists(medians, lambda m: m >= bound * S.EXPLAINED)
    largest = F.coalesce(F.array_max(medians), F.lit(0.0))
    beyond = pmin.isNull() | (bound >= pmin) | (bound > largest * S.UNEXPLAINED)
    shown = bound.isNotNull() & (support >= 2) & ~explained & beyond
    return F.when(F.coalesce(shown, F.lit(False)), S.EVIDENCE_LB).when(n_partial >= 2, S.EVIDENCE_PARTIALS).otherwise(S.EVIDENCE_NONE)


def negative_reliable(evidence: Column, dispersed: Column, n_spanning: Column, regime: Column, detectability: Column, min_support: int) -> Column:
    ruled_out = (evidence == S.EVIDENCE_LB) | dispersed | (n_spanning < min_support)
    return F.when(ruled_out, False).when(regime == "short", True).otherwise(F.coalesce(detectability >= S.MIN_DETECTABILITY, F.lit(False)))


def regime(pmax: Column, unit_len: Column) -> Column:
    return F.when(pmax.isNull() | (pmax * unit_len > S.EXPANSION_BP), "expansion").otherwise("short")


def ploidy(contig: Column, sex: str) -> Column:
    name = F.upper(F.regexp_replace(contig, "^chr", ""))
    male = sex.upper() == "XY"
    return F.when(name == "X", 1 if male else 2).when(name == "Y", 1 if male else 0).otherwise(2)


def modification_call(p_m: Column, p_h: Column, threshold: float, convention: str = "modkit") -> Column:
    """'C', 'm', 'h' or 'fail' for a site's probabilities of methyl and hydroxymethyl.

    ``ignore_h`` shares the hydroxymethyl probability out evenly; ``combine`` calls as
    ``modkit`` does and counts h as modified later.
    """
    if convention == "ignore_h":
        m, h = p_m + p_h / 2, F.lit(-1.0)
        c = F.lit(1.0) - m
    else:
        m, h = p_m, p_h
        c = F.greatest(F.lit(1.0) - p_m - p_h, F.lit(0.0))
    best = F.greatest(c, m, h)
    return F.when(best < threshold, "fail").when(m >= best, "m").when(h >= best, "h").otherwise("C")
