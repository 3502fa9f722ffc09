"""Queries that run the sequence kernels over constructed tracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tracts
from .adapters import loci

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_LEFT = "'TTATCCATTGTCCAATTACCTGTTC'"
_RIGHT = "'GTTCATAACTGACTATTCAAGTCAT'"


def segments(spark, sf_dir) -> DataFrame:
    """Reads of known tracts: the locus's motif repeated between flanks that do not continue it."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("locus"), F.col("l_quantity").cast("int").alias("truth")).distinct()
    flank = lambda s: F.lit(s.strip("'"))
    return lines.join(loci(spark, sf_dir).select("locus", "unit_len", "motif"), "locus").withColumn("seq", F.concat(flank(_LEFT), F.repeat("motif", F.col("truth")), flank(_RIGHT)))


_SEGMENTS = f"""segments as (select distinct l_partkey as locus, cast(l_quantity as int) as truth, 3 + p_size % 4 as unit_len,
  case p_size % 4 when 0 then 'CAG' when 1 then 'AAGG' when 2 then 'AAAAG' else 'GGCCTG' end as motif from lineitem join part on p_partkey = l_partkey)"""


def decompose_units(spark, sf_dir) -> DataFrame:
    runs = tracts.decompose(segments(spark, sf_dir), "seq", "unit_len", canonical=F.array("motif"))
    return runs.select("locus", "truth", F.col("run.n_units").alias("n_units"), F.col("run.labels").alias("labels"))


ORACLE_SQL["decompose_units"] = f"with {_SEGMENTS} select locus, truth, case when truth >= 2 then truth end as n_units, case when truth >= 2 then repeat('C', truth) end as labels from segments"


def find_regions(spark, sf_dir) -> DataFrame:
    found = tracts.regions(segments(spark, sf_dir), "seq", "unit_len", canonical=F.array("motif"))
    return found.select("locus", "truth", F.explode("regions").alias("r")).select("locus", "truth", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


ORACLE_SQL["find_regions"] = f'with {_SEGMENTS} select locus, truth, 25 as start, cast(25 + truth * unit_len as int) as "end" from segments where truth >= 2'


def tract_lengths(spark, sf_dir) -> DataFrame:
    """Longest exact run of the motif by regular expression, without a kernel."""
    from ..operators.tracts import longest_exact

    s = segments(spark, sf_dir)
    return s.select("locus", "truth", longest_exact(F.col("seq"), F.col("motif"), F.col("unit_len")).alias("units"))


ORACLE_SQL["tract_lengths"] = f"with {_SEGMENTS} select locus, truth, cast(truth as bigint) as units from segments"


def consensus_sequence(spark, sf_dir) -> DataFrame:
    """Consensus of five reads of every tract, two of them with an error, that recovers it; none of one unit."""
    reads = segments(spark, sf_dir).withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(4))))
    broken = F.concat(F.substring("seq", 1, 27), F.lit("T"), F.expr("substr(seq, 29)"))
    reads = reads.withColumn("seq", F.when(F.col("ord") >= 3, broken).otherwise(F.col("seq")))
    made = tracts.consensus(reads, ["locus", "truth"], "seq", "unit_len", F.array("motif"), F.col("truth"))
    return made.select("locus", "truth", "consensus", "labels")


ORACLE_SQL["consensus_sequence"] = f"with {_SEGMENTS} select locus, truth, case when truth >= 2 then repeat(motif, truth) end as consensus, case when truth >= 2 then repeat('C', truth) end as labels from segments"


def base_modifications(spark, sf_dir) -> DataFrame:
    """Sites of constructed MM/ML tags, one read a locus."""
    seq = F.concat(F.lit("ACG"), F.repeat(F.lit("CG"), (F.col("locus") % 5 + 1).cast("int")), F.lit("TCCA"))
    r = loci(spark, sf_dir).select(
        F.col("locus").alias("ord"), seq.alias("seq"), (F.col("locus") % 2 == 1).alias("reverse"), F.lit("C+m,0,1;").alias("mm"), F.array(F.lit(10), (F.col("locus") % 256).cast("int")).alias("ml"), F.lit(None).cast("int").alias("mn")
    )
    return tracts.modifications(r).select("ord", F.explode("sites").alias("s")).select("ord", "s.*")


# forward: the first and the third cytosine; reverse: the last guanine and the one two before, refused where there is none
ORACLE_SQL["base_modifications"] = """with r as (select p_partkey as ord, p_partkey % 5 + 1 as k, p_partkey % 2 = 1 as rev, p_partkey % 256 as likelihood from part),
s as (select ord, case when rev then 2 + 2 * k else 1 end as qpos, 10 as likelihood from r where k >= 2 or not rev
  union all select ord, case when rev then 2 * k - 2 when k = 1 then 6 else 5 end, likelihood from r where k >= 2 or not rev)
select ord, cast(qpos as int) as qpos, cast(likelihood + 0.5 as double) / 256 as p_m, cast(0 as double) as p_h from s"""


def period_decision(spark, sf_dir) -> DataFrame:
    """Tracts of six-base units at loci of five: the other period is told where the tract holds six of its copies."""
    from ..functions.udfs import competing_period

    s = segments(spark, sf_dir).select("locus", "truth")
    tract = F.when(F.col("locus") % 2 == 1, F.repeat(F.lit("AAAGGG"), F.col("truth"))).otherwise(F.repeat(F.lit("AAAGG"), F.col("truth")))
    return s.select("locus", "truth", competing_period(tract, F.lit(5), F.array(F.lit(6))).alias("period"))


ORACLE_SQL["period_decision"] = f"with {_SEGMENTS} select locus, truth, case when locus % 2 = 1 and truth >= 6 then 6 end as period from segments"


def crossed_units(spark, sf_dir) -> DataFrame:
    """Lower bounds of reads that leave the tract at its left or right end; none below three units."""
    s = segments(spark, sf_dir).withColumn("from_left", F.col("locus") % 2 == 0)
    window = F.struct(F.lit(25).alias("start"), (F.length("seq") - 25).alias("end"))
    return tracts.crossed(s, "seq", "unit_len", F.array("motif"), F.col("from_left"), window).select("locus", "truth", "lower_bound_units")


ORACLE_SQL["crossed_units"] = f"with {_SEGMENTS} select locus, truth, case when truth >= 3 then truth else 0 end as lower_bound_units from segments"


QUERIES |= {f.__name__: f for f in (decompose_units, find_regions, tract_lengths, consensus_sequence, base_modifications, period_decision, crossed_units)}
