"""Repeat-shaped views of the driver's tables, as DataFrames and as SQL common table expressions.

``lineitem`` plays the reads' unit counts at loci (``part``), ``events`` alignment
records at loci (users). Both engines read the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locus, units, hp (1, 2 or 0), strand, meth (0..1 in steps), conf."""
    hp = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0)
    strand = F.when(F.col("l_linestatus") == "F", "+").otherwise("-")
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("locus"), F.col("l_quantity").alias("units"), hp.alias("hp"), strand.alias("strand"), (F.col("l_discount") * 10).alias("meth"), F.col("l_tax").alias("conf")
    )


CALLS = """calls as (select l_partkey as locus, l_quantity as units,
  case l_returnflag when 'A' then 1 when 'R' then 2 else 0 end as hp,
  case l_linestatus when 'F' then '+' else '-' end as strand, l_discount * 10 as meth, l_tax as conf from lineitem)"""

_LOCI_SQL = """select p_partkey as locus, 'L' || cast(p_partkey as varchar) as id, upper(p_brand) as gene, p_brand as contig,
  cast(p_partkey * 10 as bigint) as start_pos, cast(p_partkey * 10 + 3 * (4 + p_size % 7) as bigint) as end_pos,
  case when p_size % 2 = 0 then '+' else '-' end as strand, 3 + p_size % 4 as unit_len,
  case p_size % 4 when 0 then 'CAG' when 1 then 'AAGG' when 2 then 'AAAAG' else 'GGCCTG' end as motif,
  case when p_size % 3 = 0 then null else cast(5 as double) end as bmin,
  cast(12 + p_size % 10 as double) as bmax,
  case when p_size % 8 = 0 then null else cast(13 + p_size % 10 as double) end as imin,
  case when p_size % 8 = 0 then null else cast(17 + p_size % 10 as double) end as imax,
  case when p_size % 13 = 0 then null else cast(18 + p_size % 10 as double) end as pmin,
  case when p_size % 5 = 0 then null when p_size % 11 = 0 then cast(3 as double) else cast(p_size * 20 as double) end as pmax,
  p_size % 6 = 0 as banded, cast(p_size as double) as size from part"""

#: Bands of banded loci; the last has no upper bound.
BANDS = ((15.0, "normal"), (30.0, "grey"), (None, "full"))


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per locus: interval, motif, thresholds and bands."""
    p = _table(spark, sf_dir, "part")
    size = F.col("p_size")
    motif = F.element_at(F.array(*[F.lit(m) for m in ("CAG", "AAGG", "AAAAG", "GGCCTG")]), (size % 4 + 1).cast("int"))
    number = lambda x: x.cast("double")
    bands = F.array(*[F.struct(F.lit(u).cast("double").alias("upper"), F.lit(label).alias("label")) for u, label in BANDS])
    return p.select(
        F.col("p_partkey").alias("locus"),
        F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("id"),
        F.upper("p_brand").alias("gene"),
        F.col("p_brand").alias("contig"),
        (F.col("p_partkey") * 10).alias("start_pos"),
        (F.col("p_partkey") * 10 + 3 * (4 + size % 7)).alias("end_pos"),
        F.when(size % 2 == 0, "+").otherwise("-").alias("strand"),
        (3 + size % 4).alias("unit_len"),
        motif.alias("motif"),
        F.when(size % 3 != 0, F.lit(5.0)).alias("bmin"),
        number(12 + size % 10).alias("bmax"),
        F.when(size % 8 != 0, number(13 + size % 10)).alias("imin"),
        F.when(size % 8 != 0, number(17 + size % 10)).alias("imax"),
        F.when(size % 13 != 0, number(18 + size % 10)).alias("pmin"),
        F.when(size % 5 == 0, None).when(size % 11 == 0, 3.0).otherwise(number(size * 20)).alias("pmax"),
        F.when(size % 6 == 0, bands).otherwise(F.slice(bands, 1, 0)).alias("bands"),
        number(size).alias("size"),
    )


LOCI = f"loci as ({_LOCI_SQL})"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment records: two a read name now and then, some unmapped, secondary or of low quality."""
    e = _table(spark, sf_dir, "events")
    k, units = F.col("event_id"), F.ceil("value").cast("long")
    pos = F.col("user_id") * 1000 + 700 + (k * 37) % 400
    clip = lambda n: F.struct(F.lit(4).alias("op"), n.cast("int").alias("len"))
    match = F.struct(F.lit(0).alias("op"), (100 + units).cast("int").alias("len"))
    cigar = F.concat(F.array(clip((k * 13) % 90)), F.array(match), F.array(F.struct(F.lit(1).alias("op"), (k % 7 + 1).cast("int").alias("len"))), F.array(match), F.array(clip((k * 29) % 120)))
    return e.select(
        k.alias("ord"),
        F.col("user_id").alias("locus"),
        F.concat_ws("-", F.col("user_id").cast("string"), (k % 40).cast("string")).alias("name"),
        F.when(k % 17 == 0, 4).when(k % 19 == 0, 256).when(k % 3 == 0, 16).otherwise(0).alias("flag"),
        ((k * 7) % 61).cast("int").alias("mapq"),
        F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(0).alias("hp"),
        pos.alias("pos"),
        units.alias("units"),
        cigar.alias("cigar"),
        (F.col("user_id") * 1000 + 1000).alias("start"),
        (F.col("user_id") * 1000 + 1060).alias("end"),
    )


READS = """reads as (select event_id as ord, user_id as locus, cast(user_id as varchar) || '-' || cast(event_id % 40 as varchar) as name,
  case when event_id % 17 = 0 then 4 when event_id % 19 = 0 then 256 when event_id % 3 = 0 then 16 else 0 end as flag,
  cast(event_id * 7 % 61 as int) as mapq, case event_type when 'click' then 1 when 'view' then 2 else 0 end as hp,
  user_id * 1000 + 700 + event_id * 37 % 400 as pos, cast(ceil(value) as bigint) as units,
  event_id * 13 % 90 as clip_left, event_id * 29 % 120 as clip_right, event_id % 7 + 1 as ins,
  user_id * 1000 + 1000 as start_pos, user_id * 1000 + 1060 as end_pos from events),
measured as (select *, pos + 200 + 2 * units as ref_end, clip_left + clip_right + 200 + 2 * units + ins as read_length from reads)"""
