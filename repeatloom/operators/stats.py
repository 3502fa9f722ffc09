"""Robust statistics per group, over value histograms.

Counts repeat: a deep locus has many reads and few distinct sizes. Every statistic here
works on (keys, value, n), which is aggregated before the shuffle, so the rows that a
hot locus sends grow with its distinct values and not with its depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def histogram(df: DataFrame, keys: Keys, value: Column | str) -> DataFrame:
    """(keys, value, n); null values are left out."""
    value = F.col(value) if isinstance(value, str) else value
    return df.select(*keys, value.cast("double").alias("value")).where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))


def tolerance(centre: Column) -> Column:
    return F.greatest(F.lit(2.0), centre * 0.10)


def spread(hist: DataFrame, keys: Keys) -> DataFrame:
    """n, median, mad, p5, p95 and the shares of values beyond the tolerance of the median."""
    centre = hist.groupBy(*keys).agg(F.expr("percentile(value, array(0.5d, 0.05d, 0.95d), n)").alias("q"), F.sum("n").alias("total"))
    far = hist.join(centre, keys)
    med = F.col("q")[0]
    return far.groupBy(*keys).agg(
        F.first("total").alias("n"),
        F.first(med).alias("median"),
        F.expr("percentile(abs(value - q[0]), 0.5d, n)").alias("mad"),
        F.first(F.col("q")[1]).alias("p5"),
        F.first(F.col("q")[2]).alias("p95"),
        (F.sum(F.when(F.col("value") > med + tolerance(med), F.col("n")).otherwise(0)) / F.first("total")).alias("tail_up"),
        (F.sum(F.when(F.col("value") < med - tolerance(med), F.col("n")).otherwise(0)) / F.first("total")).alias("tail_down"),
    )


def lower_bound(hist: DataFrame, keys: Keys) -> DataFrame:
    """The second largest positive value and how many values reach it; null and 0 below two values."""
    w = Window.partitionBy(*keys).orderBy(F.desc("value"))
    top = hist.where("value > 0").withColumn("r", F.row_number().over(w)).where("r <= 2")
    top = top.groupBy(*keys).agg(
        F.max(F.when(F.col("r") == 1, F.col("value"))).alias("v1"),
        F.max(F.when(F.col("r") == 1, F.col("n"))).alias("n1"),
        F.max(F.when(F.col("r") == 2, F.col("value"))).alias("v2"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("n"))), F.lit(0)).alias("n2"),
    )
    alone = F.col("n1") >= 2
    bound = F.when(alone, F.col("v1")).otherwise(F.col("v2"))
    support = F.when(alone, F.col("n1")).when(F.col("v2").isNotNull(), F.col("n1") + F.col("n2")).otherwise(0)
    return top.select(*keys, bound.alias("bound"), support.cast("long").alias("support"))


def detectability(lengths: DataFrame, keys: Keys, needed: Column) -> DataFrame:
    """Share of distinct read names whose length spans ``needed``; null where it is unknown.

    lengths: the keys, ``name``, ``length``, ``ord``; a name's first record counts.
    """
    first = lengths.groupBy(*keys, "name").agg(F.min_by("length", "ord").alias("length"), F.first(needed).alias("needed"))
    enough = (F.col("length") >= F.col("needed")).cast("double")
    return first.groupBy(*keys).agg(F.count("*").alias("n_reads"), F.avg(enough).alias("detectability"))


def modal(df: DataFrame, keys: Keys, value: str, prefer: Column, order: str) -> DataFrame:
    """The commonest value; ties to preferred values, then to the first seen, then by value."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.max(prefer.cast("int")).alias("preferred"), F.min(order).alias("seen"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("preferred"), "seen", value)
    return counted.withColumn("r", F.row_number().over(w)).where("r = 1").select(*keys, value, "n")


def majority_positions(df: DataFrame, keys: Keys, positions: str, share: float = 0.5) -> DataFrame:
    """Positions present in at least ``share`` of the rows, ascending, joined by slashes."""
    rows = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    seen = df.select(*keys, F.explode(F.array_distinct(positions)).alias("p")).groupBy(*keys, "p").agg(F.count("*").alias("n"))
    kept = seen.join(rows, keys).where(F.col("n") >= F.lit(share) * F.greatest(F.lit(1), F.col("rows")))
    joined = kept.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p.cast("string")), "/").alias("positions"))
    return rows.join(joined, keys, "left").select(*keys, "rows", F.coalesce("positions", F.lit(".")).alias("positions"))


def nearest_centre(values: DataFrame, centres: DataFrame, keys: Keys, value: str, within: bool = True) -> DataFrame:
    """Each value's nearest centre of its keys (ties to the lower index), none beyond the tolerance.

    centres: the keys, ``idx``, ``centre``; a locus has a handful.
    """
    packed = centres.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "centre"))).alias("centres"))
    v = F.col(value)
    best = F.array_min(F.transform("centres", lambda c: F.struct(F.abs(c["centre"] - v).alias("d"), c["idx"].alias("idx"), c["centre"].alias("centre"))))
    joined = values.join(packed, keys, "left").withColumn("_best", best).drop("centres")
    ok = F.col("_best.d") <= tolerance(F.col("_best.centre")) if within else F.lit(True)
    return joined.withColumn("idx", F.when(ok, F.col("_best.idx"))).drop("_best")
