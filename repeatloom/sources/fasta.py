"""Reference sequence: an indexed FASTA, read by slices through the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.geometry import period_flanks

INDEX = "contig string, length bigint, offset bigint, line_bases int, line_width int"


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """The index beside a FASTA: contig, length, offset, line_bases, line_width."""
    return spark.read.csv(f"{path}.fai", sep="\t", schema=INDEX)


class Fasta:
    """Slices of a local FASTA for the few intervals of a catalogue."""

    def __init__(self, path: str):
        self.path, self.index = path, {}
        with open(f"{path}.fai") as f:
            for row in f:
                name, *numbers = row.rstrip("\n").split("\t")
                self.index[name] = tuple(map(int, numbers[:4]))

    def fetch(self, contig: str, start: int, end: int) -> str:
        """Bases [start, end), clamped to the contig, case kept."""
        length, offset, bases, width = self.index[contig]
        start, end = max(0, start), min(end, length)
        if start >= end:
            return ""
        place = lambda p: offset + p // bases * width + p % bases
        with open(self.path, "rb") as f:
            f.seek(place(start))
            return f.read(place(end - 1) + 1 - place(start)).decode().replace("\n", "").replace("\r", "")


def resolve(names: set[str], contig: str) -> str | None:
    """A catalogue's contig in a file's naming: as it is, with or without chr, or the mitochondrion's other name."""
    other = contig[3:] if contig.startswith("chr") else f"chr{contig}"
    mito = {"chrM": "MT", "MT": "chrM"}.get(contig)
    return next((c for c in (contig, other, mito) if c in names), None)


def annotate(loci: DataFrame, path: str, flank: int = 100, margin: int = 12) -> DataFrame:
    """Loci with ``ref_tract``, ``ref_pad`` and ``period`` (flank bases that continue the repeat).

    A catalogue is small: its intervals are fetched on the driver and joined back.
    """
    fasta, rows = Fasta(path), []
    for r in loci.select("id", "contig", "start_pos", "end_pos", "unit_len").toLocalIterator():
        name = resolve(set(fasta.index), r["contig"])
        if name is None:
            continue
        reach = max(flank, margin, 2 * r["unit_len"])
        lo = max(0, r["start_pos"] - reach)
        around = fasta.fetch(name, lo, r["end_pos"] + reach).upper()
        left, right = period_flanks(around, lo, r["start_pos"], r["end_pos"], r["unit_len"], reach)
        pad = fasta.fetch(name, r["start_pos"] - 1, r["start_pos"]).upper() if r["start_pos"] > 0 else None
        rows.append((r["id"], fasta.fetch(name, r["start_pos"], r["end_pos"]).upper(), pad, (left, right)))
    found = loci.sparkSession.createDataFrame(rows, "id string, ref_tract string, ref_pad string, period struct<left:int,right:int>").withColumn("in_reference", F.lit(True))
    return loci.drop("ref_tract", "ref_pad", "period", "in_reference").join(found, "id", "left").fillna(False, ["in_reference"])


def mismatched(loci: DataFrame, alignment_contigs: DataFrame, reference_contigs: DataFrame) -> DataFrame:
    """Loci whose contig is missing from the reference or has another length there than in the alignment."""
    a = alignment_contigs.select("contig", F.col("length").alias("alignment_length"))
    r = reference_contigs.select("contig", F.col("length").alias("reference_length"))
    joined = loci.select("id", "contig").join(a, "contig").join(r, "contig", "left")
    return joined.where("reference_length is null or reference_length != alignment_length")


def cover_by_motif(loci: DataFrame) -> DataFrame:
    """Share of each reference tract that exact runs of the locus's motifs cover; low shares
    at most loci mean that catalogue and reference are of different builds."""
    from ..operators.tracts import regions

    found = regions(loci.where("ref_tract is not null and ref_tract != ''"), "ref_tract", "unit_len", F.col("ref_motifs"), pathogenic=F.col("pathogenic_motifs"), benign=F.col("benign_motifs"))
    covered = F.aggregate("regions", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return found.select("id", (covered / F.length("ref_tract")).alias("cover"))


def build_suspect(loci: DataFrame, cover: float = 0.30, share: float = 0.50, least: int = 8) -> bool:
    row = cover_by_motif(loci).agg(F.count("*").alias("n"), F.count_if(F.col("cover") < cover).alias("low")).first()
    return row["n"] >= least and row["low"] / row["n"] > share
