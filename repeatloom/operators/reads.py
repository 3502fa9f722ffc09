"""From alignment records to one observation of each read at each locus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as Q
from ..schema import Options

UNMAPPED, SECONDARY = 0x4, 0x100


def usable(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """Mapped, primary or supplementary records of enough mapping quality."""
    return reads.where((F.col("flag").bitwiseAND(UNMAPPED | SECONDARY) == 0) & (F.col("mapq") >= options.min_mapq))


def measured(reads: DataFrame) -> DataFrame:
    """With what a CIGAR says: reference end, read length, clips."""
    c = F.col("cigar")
    return reads.withColumns(
        {
            "ref_end": Q.reference_end(F.col("pos"), c),
            "read_length": Q.read_length(c),
            "clip_left": Q.left_clip(c),
            "clip_right": Q.right_clip(c),
            "align_start": Q.soft_run(c).cast("long"),
            "align_end": Q.span(c, Q.QUERY_OPS) - Q.soft_run(c, True),
        }
    )


def classify_reads(df: DataFrame, options: Options = Options()) -> DataFrame:
    """``read_class`` of records joined to loci (``start``, ``end``): spanning,
    left_partial, right_partial, or null for those that fit none."""
    left = F.col("pos") <= F.col("start") - options.flank
    right = F.col("ref_end") >= F.col("end") + options.flank
    kind = (
        F.when(left & right, "spanning")
        .when(left & (F.col("clip_right") >= options.min_clip), "left_partial")
        .when(right & (F.col("clip_left") >= options.min_clip), "right_partial")
    )
    return df.withColumn("read_class", kind)


def first_spanning(obs: DataFrame) -> DataFrame:
    """One spanning record a read name and locus: the first that has a segment."""
    w = Window.partitionBy("locus", "name").orderBy("ord")
    spanning = obs.where((F.col("read_class") == "spanning") & F.col("has_segment"))
    return spanning.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def partials(obs: DataFrame, spanning: DataFrame) -> DataFrame:
    """Partial records of names that do not span the locus."""
    part = obs.where(F.col("read_class").isin("left_partial", "right_partial"))
    return part.join(spanning.select("locus", "name").distinct(), ["locus", "name"], "left_anti")


def pair_splits(part: DataFrame) -> DataFrame:
    """A left and a right partial of one name and strand with bases between: the first pair by order.

    Columns: locus, name, l_ord, r_ord, gap, mapq (the lower), hp (the left's, else the right's).
    part: locus, name, reverse, read_class, ord, mapq, hp, edge (the coordinate in the
    read, in its own direction, where the record meets the tract).
    """
    side = lambda kind, p: part.where(F.col("read_class") == kind).select("locus", "name", "reverse", *[F.col(c).alias(p + c) for c in ("ord", "mapq", "hp", "edge")])
    gap = F.when(F.col("reverse"), F.col("l_edge") - F.col("r_edge")).otherwise(F.col("r_edge") - F.col("l_edge"))
    both = side("left_partial", "l_").join(side("right_partial", "r_"), ["locus", "name", "reverse"]).withColumn("gap", gap).where("gap > 0")
    w = Window.partitionBy("locus", "name").orderBy("l_ord", "r_ord")
    first = both.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    hp = F.when(F.col("l_hp") != 0, F.col("l_hp")).otherwise(F.col("r_hp"))
    return first.select("locus", "name", "l_ord", "r_ord", "gap", F.least("l_mapq", "r_mapq").alias("mapq"), hp.alias("hp"))


def best_partial(part: DataFrame, paired: DataFrame) -> DataFrame:
    """Of names without a pair, the partial with a segment and the highest quality; first on ties."""
    alone = part.join(paired.select("locus", "name"), ["locus", "name"], "left_anti")
    w = Window.partitionBy("locus", "name").orderBy(F.desc("has_segment"), F.desc("mapq"), "ord")
    return alone.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
