"""Queries over alignment records and intervals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import classify as C
from ..functions import sequence as Q
from ..operators import intervals, stats
from ..operators import reads as R
from .adapters import LOCI, READS, loci, reads

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_OBS = f"""{READS}, usable as (select * from measured where flag in (0, 16) and mapq >= 20),
routed as (select *, pos <= start_pos - 100 as cl, ref_end >= end_pos + 100 as cr from usable),
obs as (select *, case when cl and cr then 'spanning' when cl and clip_right >= 50 then 'left_partial' when cr and clip_left >= 50 then 'right_partial' end as read_class from routed)"""


def observed(spark, sf_dir) -> DataFrame:
    return R.classify_reads(R.measured(R.usable(reads(spark, sf_dir))))


@query(f"with {_OBS} select locus, ord, name, mapq, read_class from obs")
def read_router(spark, sf_dir) -> DataFrame:
    return observed(spark, sf_dir).select("locus", "ord", "name", "mapq", "read_class")


@query(f"with {READS} select ord, ref_end, read_length, cast(clip_left as bigint) as clip_left, cast(clip_right as bigint) as clip_right, clip_left as align_start, read_length - clip_right as align_end from measured")
def cigar_folds(spark, sf_dir) -> DataFrame:
    m = R.measured(reads(spark, sf_dir))
    return m.select("ord", "ref_end", "read_length", *[F.col(c).cast("long").alias(c) for c in ("clip_left", "clip_right", "align_start", "align_end")])


_PART = f"""{_OBS}, span as (select * from (select *, row_number() over (partition by locus, name order by ord) as k from obs where read_class = 'spanning' and ord % 23 <> 0) where k = 1),
part as (select o.*, flag = 16 as rev, ord % 5 <> 0 as seg, case when flag = 16 then read_length - pos % 97 else pos % 211 end as edge from obs o
  where read_class in ('left_partial', 'right_partial') and not exists (select 1 from span s where s.locus = o.locus and s.name = o.name)),
pairs as (select l.locus, l.name, l.ord as l_ord, r.ord as r_ord, case when l.rev then l.edge - r.edge else r.edge - l.edge end as gap,
  least(l.mapq, r.mapq) as mapq, case when l.hp <> 0 then l.hp else r.hp end as hp
  from part l join part r on l.locus = r.locus and l.name = r.name and l.rev = r.rev and l.read_class = 'left_partial' and r.read_class = 'right_partial'),
split as (select * from (select *, row_number() over (partition by locus, name order by l_ord, r_ord) as k from pairs where gap > 0) where k = 1)"""


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    obs = observed(spark, sf_dir).withColumn("has_segment", F.col("ord") % 23 != 0)
    spanning = R.first_spanning(obs)
    reverse = F.col("flag") == 16
    edge = F.when(reverse, F.col("read_length") - F.col("pos") % 97).otherwise(F.col("pos") % 211)
    part = R.partials(obs, spanning).withColumns({"reverse": reverse, "edge": edge, "has_segment": F.col("ord") % 5 != 0})
    return spanning, part


@query(f"with {_PART} select locus, name, ord from span")
def first_spanning(spark, sf_dir) -> DataFrame:
    return _parts(spark, sf_dir)[0].select("locus", "name", "ord")


@query(f"with {_PART} select locus, name, l_ord, r_ord, gap, mapq, hp from split")
def split_pairing(spark, sf_dir) -> DataFrame:
    return R.pair_splits(_parts(spark, sf_dir)[1]).select("locus", "name", "l_ord", "r_ord", "gap", "mapq", "hp")


@query(
    f"""with {_PART} select locus, name, ord, read_class from (select p.*, row_number() over (partition by p.locus, p.name order by p.seg desc, p.mapq desc, p.ord) as k
    from part p where not exists (select 1 from split s where s.locus = p.locus and s.name = p.name)) where k = 1"""
)
def best_partial(spark, sf_dir) -> DataFrame:
    part = _parts(spark, sf_dir)[1]
    return R.best_partial(part, R.pair_splits(part)).select("locus", "name", "ord", "read_class")


@query(
    f"""with {_OBS}, first as (select locus, name, min_by(read_length, ord) as len from usable group by locus, name),
    d as (select locus, count(*) as n_reads, avg(case when len >= 300 + locus % 7 * 100 then cast(1 as double) else cast(0 as double) end) as det from first group by locus),
    s as (select locus, count(case when read_class = 'spanning' then 1 end) as n_spanning from obs group by locus)
    select d.locus, n_reads, round(det, 3) as detectability, case when n_spanning < 3 then false when d.locus % 2 = 0 then true else det >= 0.8 end as negative_reliable
    from d join s using (locus)"""
)
def detectability_negative(spark, sf_dir) -> DataFrame:
    obs = observed(spark, sf_dir)
    lengths = obs.select("locus", "name", F.col("read_length").alias("length"), "ord")
    d = stats.detectability(lengths, ["locus"], 300 + F.col("locus") % 7 * 100)
    s = obs.groupBy("locus").agg(F.count_if(F.col("read_class") == "spanning").alias("n_spanning"))
    regime = F.when(F.col("locus") % 2 == 0, "short").otherwise("expansion")
    reliable = C.negative_reliable(F.lit(S.EVIDENCE_NONE), F.lit(False), F.col("n_spanning"), regime, F.col("detectability"), 3)
    return d.join(s, "locus").select("locus", "n_reads", F.round("detectability", 3).alias("detectability"), reliable.alias("negative_reliable"))


_LINES = "lines as (select l_orderkey as ok, l_linenumber as ln, p.p_brand as contig, l_partkey * 10 + l_suppkey % 50 as s, l_partkey * 10 + l_suppkey % 50 + cast(l_quantity as bigint) as e from lineitem join part p on p_partkey = l_partkey)"


@query(f"with {LOCI}, {_LINES} select l.locus, count(*) as n, min(x.s) as first_start, max(x.e) as last_end from lines x join loci l on l.contig = x.contig and x.s < l.end_pos and x.e > l.start_pos group by l.locus")
def interval_join(spark, sf_dir) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    start = F.col("l_partkey") * 10 + F.col("l_suppkey") % 50
    lines = t("lineitem").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    left = lines.select(F.col("p_brand").alias("contig"), start.alias("l_start"), (start + F.col("l_quantity").cast("long")).alias("l_end"))
    right = loci(spark, sf_dir).select("locus", "contig", F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"))
    hits = intervals.interval_join(left, right, width=1024)
    return hits.groupBy("locus").agg(F.count("*").alias("n"), F.min("l_start").alias("first_start"), F.max("l_end").alias("last_end"))


@query(
    f"""with {LOCI}, o as (select *, max(end_pos) over (partition by contig order by start_pos, locus rows between unbounded preceding and 1 preceding) as before from loci),
    g as (select *, sum(case when before is null or start_pos > before then 1 else 0 end) over (partition by contig order by start_pos, locus) as grp from o)
    select contig, min(start_pos) as start, max(end_pos) as "end", string_agg(id, ',' order by start_pos, locus) as names from g group by contig, grp"""
)
def bed_merge(spark, sf_dir) -> DataFrame:
    rows = loci(spark, sf_dir).select("contig", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.col("id").alias("name"), F.col("locus").alias("ord"))
    return intervals.merge_intervals(rows)


@query(
    f"""with {LOCI} select id, gene, contig, greatest(start_pos - 50, 0) as start, end_pos + 50 as "end", cast(unit_len as int) as unit_len, motif,
    case when pmax is null or pmax * unit_len > 1000 then 'expansion' else 'short' end as regime,
    case when contig = 'Brand#11' then 1 else 2 end as ploidy from loci"""
)
def catalog_listing(spark, sf_dir) -> DataFrame:
    regime = C.regime(F.col("pmax"), F.col("unit_len"))
    contig = F.when(F.col("contig") == "Brand#11", "chrX").otherwise("chr1")
    return loci(spark, sf_dir).select(
        "id", "gene", "contig", F.greatest(F.col("start_pos") - 50, F.lit(0)).alias("start"), (F.col("end_pos") + 50).alias("end"), F.col("unit_len").cast("int").alias("unit_len"), "motif",
        regime.alias("regime"), C.ploidy(contig, "XY").alias("ploidy"),
    )


@query(f"with {LOCI} select l.id, cast(k.key as varchar) as key from loci l join (select unnest(['l7', 'L12', 'brand#23']) as key) k on upper(k.key) in (upper(l.id), l.gene)")
def alias_lookup(spark, sf_dir) -> DataFrame:
    from ..sources.catalog import lookup

    return lookup(loci(spark, sf_dir), ["l7", "L12", "brand#23"], ["id", "gene"]).select("id", "key")
