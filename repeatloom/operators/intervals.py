"""Interval joins and interval merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import overlap

def bins(start: Column, end: Column, width: int) -> Column:
    """Numbers of the bins that a half-open interval touches; an empty one touches its start's."""
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width))


def interval_join(left: DataFrame, right: DataFrame, width: int = 16_384) -> DataFrame:
    """Pairs of rows on one contig that overlap (half-open).

    Both sides have ``contig``; left ``l_start``, ``l_end``, right ``r_start``, ``r_end``.
    Both are cut into bins of ``width`` and joined by (contig, bin); a pair is kept in the
    first bin that it shares, so no distinct follows. Whether the smaller side is sent to
    all tasks is Spark's decision, from its measured size; skewed bins are split by it.
    """
    hit = overlap(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    a = left.withColumn("_bin", F.explode(bins(F.col("l_start"), F.col("l_end"), width)))
    b = right.withColumn("_bin", F.explode(bins(F.col("r_start"), F.col("r_end"), width)))
    first = F.greatest(F.floor(F.col("l_start") / width), F.floor(F.col("r_start") / width))
    return a.join(b, ["contig", "_bin"]).where(hit & (F.col("_bin") == first)).drop("_bin")


def _merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, start, end, members) that touch or overlap within the keys, as one row each."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # the running maximum over all earlier rows of the keys equals that of the open group
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    marked = marked.withColumn("_group", F.sum("_new").over(w))
    members = F.flatten(F.collect_list("members")).alias("members")
    return marked.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), members).drop("_group")


def merge_intervals(df: DataFrame, order: str = "ord", width: int = 1 << 20) -> DataFrame:
    """Intervals of a contig that touch or overlap, as one: (contig, start, end, names).

    df: contig, start, end, name and an order that breaks ties of (contig, start); with a
    ``motif``, that of the first interval is given too. They are
    merged among those that start in one bin of ``width`` first, which splits a contig
    over tasks; what is left, of which a dense bin has few, is merged by contig.
    """
    more = [c for c in ("motif",) if c in df.columns]
    one = F.array(F.struct("start", F.col(order).alias("ord"), "name", *more)).alias("members")
    binned = df.select("contig", F.floor(F.col("start") / width).alias("_bin"), "start", "end", one)
    whole = _merged(_merged(binned, ["contig", "_bin"]).drop("_bin"), ["contig"])
    names = F.array_join(F.transform(F.sort_array("members"), lambda s: s["name"]), ",")
    first = [F.array_min("members")[c].alias(c) for c in more]
    return whole.select("contig", "start", "end", *first, names.alias("names"))
