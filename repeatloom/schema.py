"""Fixed names, constants and schemas of the tandem-repeat operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Output columns of the per-read table, in order.
PER_READ_COLUMNS = (
    "locus read_id read_class hp allele strand mapq read_length size_bp tract_len_bp n_total_units n_canonical "
    "n_interruption n_pathogenic n_benign n_other units_estimated lower_bound_units interruption_motifs_observed "
    "interruption_positions structure_string frac_5mc n_5mc_valid n_5mc_fail mean_5mc_prob n_5mc_sites cpg_5mc "
    "frac_5mc_up n_5mc_up_valid n_5mc_up_fail mean_5mc_up n_5mc_up mean_5mc_down n_5mc_down"
).split()
# Output columns of the per-locus table; the allele columns come twice, prefixed a1_ and a2_.
LOCUS_COLUMNS = (
    "sample locus gene chrom start end gene_strand motif_gene motif_ref unit_len regime composition ref_copies ploidy "
    "method n_reads_total n_spanning n_split n_partial n_no_run"
).split()
ALLELE_COLUMNS = (
    "median median_measured p5 p95 mad support size_bp tail_up_frac noise n_interruption int_pos n_pathogenic cls "
    "dispersed structure meth_tract meth_tract_pooled meth_hydroxy meth_fail_frac meth_up meth_up_pooled meth_down "
    "frac_meth_reads_gt50"
).split()
LOCUS_TAIL_COLUMNS = "minor_modes lower_bound_units lower_bound_support detectability evidence negative_reliable tagged_fraction meth_convention notes".split()


def locus_header() -> list[str]:
    return [*LOCUS_COLUMNS, *[f"a{k}_{c}" for k in (1, 2) for c in ALLELE_COLUMNS], *LOCUS_TAIL_COLUMNS]


# Class and evidence labels.
BENIGN, INTERMEDIATE, PATHOGENIC, UNCERTAIN, NO_CALL = "benign", "intermediate", "pathogenic", "uncertain", "no_call"
EVIDENCE_NONE, EVIDENCE_PARTIALS, EVIDENCE_LB = "NONE", "PARTIALS_PRESENT", "EXPANSION_LB"

# Thresholds of the method.
BAND_TOP = 1e9
EXPANSION_BP = 1000
DISPERSION_SLACK, DISPERSION_FLOOR, DISPERSION_READS = 1.5, 3.0, 2
EXPLAINED, UNEXPLAINED = 0.9, 1.5
MIN_DETECTABILITY = 0.8
QUANT_VAR, REL_SD, SEP_K, SEP_MIN = 1.0 / 12.0, 0.02, 2.0, 0.9
BUILDS = ("hg38", "t2t", "hg19")


@dataclass(frozen=True)
class Options:
    """Knobs of a run, with their defaults."""

    anchor: int = 50
    flank: int = 100
    min_mapq: int = 20
    min_clip: int = 50
    margin: int = 12
    min_support: int = 3
    min_frac: float = 0.10
    sex: str = "XX"
    use_hp: bool = True
    mosaic: bool = False
    clinical: bool = False
    meth_threshold: float = 0.8
    meth_convention: str = "modkit"


CIGAR = T.ArrayType(T.StructType([T.StructField("op", T.IntegerType()), T.StructField("len", T.IntegerType())]))
READS = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("contig", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("cigar", CIGAR),
        T.StructField("seq", T.StringType()),
        T.StructField("hp", T.IntegerType()),
        T.StructField("mm", T.StringType()),
        T.StructField("ml", T.ArrayType(T.IntegerType())),
        T.StructField("mn", T.IntegerType()),
    ]
)
BANDS = T.ArrayType(T.StructType([T.StructField("upper", T.DoubleType()), T.StructField("label", T.StringType())]))
