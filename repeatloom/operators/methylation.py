"""Methylation of reads and alleles from per-site probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import modification_call

THRESHOLD, READ_SITES = 0.8, 3


def window_counts(sites: DataFrame, keys: list[str], threshold: float = THRESHOLD, convention: str = "modkit") -> DataFrame:
    """Counts of calls per keys: mean probability, n, n_valid, n_mod, n_fail, n_hydroxy, frac, fail.

    sites: the keys, ``pm`` and ``ph``. frac counts h as modified under ``combine``.
    """
    call = modification_call(F.col("pm"), F.col("ph"), threshold, convention)
    of = lambda c: F.count_if(F.col("_call") == c)
    counted = sites.withColumn("_call", call).groupBy(*keys).agg(
        F.avg("pm").alias("mean"), F.count("*").alias("n"), F.count_if(F.col("_call") != "fail").alias("n_valid"), of("m").alias("n_mod"), of("fail").alias("n_fail"), of("h").alias("n_hydroxy")
    )
    top = F.col("n_mod") + F.col("n_hydroxy") if convention == "combine" else F.col("n_mod")
    share = lambda x, n: F.when(n > 0, x / n)
    return counted.withColumns({"frac": share(top, F.col("n_valid")), "hydroxy_frac": share(F.col("n_hydroxy"), F.col("n_valid")), "fail": share(F.col("n_fail"), F.col("n"))})


def allele_methylation(reads: DataFrame, keys: list[str]) -> DataFrame:
    """An allele's methylation from its reads' windows: mean of fractions, pooled share,
    hydroxymethyl and failed shares, and the share of reads at or above one half."""
    enough = F.when(F.col("n_valid") >= READ_SITES, (F.col("frac") >= 0.5).cast("double"))
    valid = F.sum("n_valid")
    return reads.groupBy(*keys).agg(
        F.avg("frac").alias("meth_mean"), F.when(valid > 0, F.sum("n_mod") / valid).alias("pooled"), F.avg("hydroxy_frac").alias("hydroxy"), F.avg("fail").alias("fail_frac"), F.avg(enough).alias("gt50")
    )


def by_unit(reads: DataFrame, keys: list[str], sites: str = "cpg_5mc", unit_len: str = "unit_len") -> DataFrame:
    """Mean methylation of each repeat unit from ``offset:percent`` lists: keys, unit, n, mean."""
    pairs = F.filter(F.split(sites, ","), lambda x: F.contains(x, F.lit(":")))
    one = reads.select(*keys, unit_len, F.explode(pairs).alias("_s"))
    part = F.split("_s", ":")
    unit = F.floor(part[0].cast("int") / F.col(unit_len)).cast("int")
    return one.select(*keys, unit.alias("unit"), (part[1].cast("double") / 100).alias("p")).groupBy(*keys, "unit").agg(F.count("*").alias("n"), F.avg("p").alias("mean"))
