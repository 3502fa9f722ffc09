"""Queries over unit counts at loci, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import classify as C
from ..functions import sequence as Q
from ..functions import text as X
from ..operators import stats
from ..operators.call import assign_alleles, locus_table
from .adapters import CALLS, LOCI, calls, loci

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r3(c) -> F.Column:
    return F.round(c, 3)


THRESHOLDS = ("bmin", "bmax", "imin", "imax", "pmin", "pmax")

_SPREAD = """med as (select locus, hp, count(*) as n, median(units) as med, quantile_cont(units, 0.05) as p5, quantile_cont(units, 0.95) as p95 from calls group by locus, hp),
spread as (select c.locus, c.hp, m.n, m.med, m.p5, m.p95, median(abs(c.units - m.med)) as mad,
  avg(case when c.units > m.med + greatest(2, 0.1 * m.med) then cast(1 as double) else cast(0 as double) end) as tail_up,
  avg(case when c.units < m.med - greatest(2, 0.1 * m.med) then cast(1 as double) else cast(0 as double) end) as tail_down
  from calls c join med m on c.locus = m.locus and c.hp = m.hp group by c.locus, c.hp, m.n, m.med, m.p5, m.p95)"""


@query(f"with {CALLS}, {_SPREAD} select locus, hp, n, med as median, round(mad, 3) as mad, round(p5, 3) as p5, round(p95, 3) as p95, round(tail_up, 3) as tail_up, round(tail_down, 3) as tail_down from spread")
def allele_spread(spark, sf_dir) -> DataFrame:
    keys = ["locus", "hp"]
    s = stats.spread(stats.histogram(calls(spark, sf_dir), keys, "units"), keys)
    return s.select("locus", "hp", "n", "median", *[r3(F.col(c)).alias(c) for c in ("mad", "p5", "p95", "tail_up", "tail_down")])


_BOUND = """ranked as (select locus, units, row_number() over (partition by locus order by units desc) as r from partial where units > 0),
bound as (select locus, max(case when r = 2 then units end) as bound from ranked group by locus),
support as (select b.locus, b.bound, case when b.bound is null then 0 else count(case when r.units >= b.bound then 1 end) end as support
  from bound b join ranked r on b.locus = r.locus group by b.locus, b.bound)"""


@query(
    f"""with {CALLS}, {LOCI}, partial as (select * from calls where hp = 0), {_BOUND},
    meds as (select locus, list(m order by hp) as medians from (select locus, hp, median(units) as m from calls where hp > 0 group by locus, hp) group by locus),
    parts as (select locus, count(*) as n_partial from partial group by locus)
    select l.locus, s.bound, cast(coalesce(s.support, 0) as bigint) as support, cast(coalesce(p.n_partial, 0) as bigint) as n_partial,
      case when s.bound is not null and s.support >= 2 and not coalesce(list_bool_or(list_transform(m.medians, lambda x: x >= 0.9 * s.bound)), false)
        and (l.pmin is null or s.bound >= l.pmin or s.bound > 1.5 * coalesce(list_max(m.medians), 0)) then 'EXPANSION_LB'
        when coalesce(p.n_partial, 0) >= 2 then 'PARTIALS_PRESENT' else 'NONE' end as evidence
    from loci l left join support s using (locus) left join meds m using (locus) left join parts p using (locus)"""
)
def lower_bound_evidence(spark, sf_dir) -> DataFrame:
    all_calls, key = calls(spark, sf_dir), ["locus"]
    partial = stats.histogram(all_calls.where("hp = 0"), key, "units")
    bounds = stats.lower_bound(partial, key)
    n_partial = partial.groupBy("locus").agg(F.sum("n").alias("n_partial"))
    hist = stats.histogram(all_calls.where("hp > 0"), ["locus", "hp"], "units")
    meds = hist.groupBy("locus", "hp").agg(F.expr("percentile(value, 0.5d, n)").alias("m")).groupBy("locus").agg(F.collect_list("m").alias("medians"))
    joined = loci(spark, sf_dir).select("locus", "pmin").join(bounds, "locus", "left").join(meds, "locus", "left").join(n_partial, "locus", "left")
    medians = F.coalesce("medians", F.expr("cast(array() as array<double>)"))
    n_partial = F.coalesce("n_partial", F.lit(0))
    state = C.evidence_state(F.col("bound"), F.coalesce("support", F.lit(0)), medians, F.col("pmin"), n_partial)
    return joined.select("locus", "bound", F.coalesce("support", F.lit(0)).cast("long").alias("support"), n_partial.cast("long").alias("n_partial"), state.alias("evidence"))


@query(
    f"""with {CALLS} select locus, count(*) as n, round(avg(case when hp in (1, 2) then cast(1 as double) else cast(0 as double) end), 3) as tagged_fraction from calls group by locus"""
)
def tagged_fraction(spark, sf_dir) -> DataFrame:
    tagged = F.avg(F.col("hp").isin(1, 2).cast("double"))
    return calls(spark, sf_dir).groupBy("locus").agg(F.count("*").alias("n"), r3(tagged).alias("tagged_fraction"))


_CLASS = """case when u is null then 'no_call'
  when pmin is not null and pmax is not null and bmin is not null and pmax < bmin then
    case when u <= pmax then 'pathogenic' when u <= bmax and u >= bmin then 'benign' else 'uncertain' end
  when u <= bmax and (bmin is null or u >= bmin) then 'benign' when u >= imin and u <= imax then 'intermediate'
  when u >= pmin then 'pathogenic' when u <= bmax then 'benign' else 'uncertain' end"""


def _medians(spark, sf_dir) -> DataFrame:
    hist = stats.histogram(calls(spark, sf_dir), ["locus", "hp"], "units")
    return hist.groupBy("locus", "hp").agg(F.expr("percentile(value, 0.5d, n)").alias("u"))


@query(f"with {CALLS}, {LOCI}, m as (select locus, hp, median(units) as u from calls group by locus, hp) select m.locus, m.hp, m.u as units, {_CLASS} as cls from m join loci using (locus)")
def size_class_thresholds(spark, sf_dir) -> DataFrame:
    rows = _medians(spark, sf_dir).join(loci(spark, sf_dir), "locus")
    return rows.select("locus", "hp", F.col("u").alias("units"), C.classify_thresholds(F.col("u"), *map(F.col, THRESHOLDS)).alias("cls"))


@query(
    f"""with {CALLS}, {LOCI}, m as (select locus, hp, median(units) as u from calls group by locus, hp)
    select m.locus, m.hp, m.u as units, case when banded then case when u <= 15 then 'normal' when u <= 30 then 'grey' when u <= 1e9 then 'full' else 'no_call' end else {_CLASS} end as cls
    from m join loci using (locus)"""
)
def size_class_bands(spark, sf_dir) -> DataFrame:
    rows = _medians(spark, sf_dir).join(loci(spark, sf_dir), "locus")
    return rows.select("locus", "hp", F.col("u").alias("units"), C.classify(F.col("u"), F.col("bands"), *map(F.col, THRESHOLDS)).alias("cls"))


@query(
    f"""with {CALLS}, {LOCI}, d as (select c.locus, c.units as total, c.meth as nint, c.hp, l.size, l.unit_len from calls c join loci l using (locus))
    select locus, cast(sum(case when unit_len % 2 = 0 then total else greatest(total - nint, 0) end) as double) as clinical,
      cast(sum(case when size % 4 = 0 then nint else greatest(total - hp, 0) end) as double) as classed from d group by locus"""
)
def reported_sizes(spark, sf_dir) -> DataFrame:
    d = calls(spark, sf_dir).join(loci(spark, sf_dir), "locus")
    clinical = C.size_units(F.col("units"), F.col("meth"), F.lit(True), F.col("unit_len") % 2 == 0)
    classed = C.class_units(F.col("units"), F.col("hp").cast("double"), F.col("meth"), F.col("size") % 4 == 0)
    return d.groupBy("locus").agg(F.round(F.sum(clinical), 6).alias("clinical"), F.round(F.sum(classed), 6).alias("classed"))


ORACLE_SQL["reported_sizes"] = ORACLE_SQL["reported_sizes"].replace("cast(sum(", "round(cast(sum(").replace("as double) as c", "as double), 6) as c")


@query(f"with {CALLS}, {_SPREAD} select locus, hp, p95 > greatest(med * 1.5, med + 3) and round_even(tail_up * n, 0) >= 2 as dispersed from spread")
def over_dispersed(spark, sf_dir) -> DataFrame:
    keys = ["locus", "hp"]
    s = stats.spread(stats.histogram(calls(spark, sf_dir), keys, "units"), keys)
    return s.select("locus", "hp", C.over_dispersed(F.col("median"), F.col("p95"), F.col("tail_up"), F.col("n")).alias("dispersed"))


@query(
    f"""with {CALLS}, {LOCI}, r as (select locus, l_q, count(*) as n, max(case when l_q % 5 = 0 then 1 else 0 end) as pref, min(seen) as seen
      from (select locus, cast(units as bigint) as l_q, cast(units as bigint) * 7 % 53 as seen from calls) group by locus, l_q)
    select locus, l_q as unit, n from (select *, row_number() over (partition by locus order by n desc, pref desc, seen, l_q) as k from r) where k = 1"""
)
def modal_unit(spark, sf_dir) -> DataFrame:
    rows = calls(spark, sf_dir).select("locus", F.col("units").cast("long").alias("unit"))
    return stats.modal(rows.withColumn("seen", F.col("unit") * 7 % 53), ["locus"], "unit", F.col("unit") % 5 == 0, "seen").select("locus", "unit", "n")


@query(
    f"""with {CALLS}, rows as (select locus, count(*) as n from calls group by locus),
    pos as (select locus, unnest([cast(units as bigint) % 4, cast(units as bigint) % 3 + 5, 9]) as p from calls),
    seen as (select locus, p, count(*) as n from pos group by locus, p)
    select r.locus, r.n as rows, coalesce(string_agg(cast(s.p as varchar), '/' order by s.p), '.') as positions
    from rows r left join seen s on r.locus = s.locus and s.n >= 0.5 * r.n group by r.locus, r.n"""
)
def interruption_consensus(spark, sf_dir) -> DataFrame:
    u = F.col("units").cast("long")
    rows = calls(spark, sf_dir).select("locus", F.array(u % 4, u % 3 + 5, F.lit(9).cast("long")).alias("p"))
    return stats.majority_positions(rows, ["locus"], "p")


@query(
    f"""with {CALLS}, d as (select c.locus, c.hp, c.units, row_number() over () as rid from calls c where hp = 0),
    centres as (select locus, hp - 1 as idx, median(units) as centre from calls where hp > 0 group by locus, hp),
    j as (select d.*, c.idx, c.centre, row_number() over (partition by d.rid order by abs(d.units - c.centre), c.idx) as k from d left join centres c using (locus))
    select locus, units, cast(case when abs(units - centre) <= greatest(2, 0.1 * centre) then idx end as int) as allele, count(*) as n from j where k = 1 group by all"""
)
def nearest_centre(spark, sf_dir) -> DataFrame:
    c = calls(spark, sf_dir)
    hist = stats.histogram(c.where("hp > 0"), ["locus", "hp"], "units")
    centres = hist.groupBy("locus", "hp").agg(F.expr("percentile(value, 0.5d, n)").alias("centre")).select("locus", (F.col("hp") - 1).alias("idx"), "centre")
    near = stats.nearest_centre(stats.histogram(c.where("hp = 0"), ["locus"], "units"), centres, ["locus"], "value")
    return near.select("locus", F.col("value").alias("units"), F.col("idx").cast("int").alias("allele"), "n")


@query(
    f"""with {LOCI} select locus, upper(motif) as motif, translate(reverse(upper(motif)), 'ACGT', 'TGCA') as revcomp,
    case when strand = '+' then upper(motif) else translate(reverse(upper(motif)), 'ACGT', 'TGCA') end as gene_motif,
    array_to_string(list_transform(range(0, length(motif)), lambda k: motif[k + 1:] || motif[1:k]), ',') as rotations from loci"""
)
def motif_revcomp_rotations(spark, sf_dir) -> DataFrame:
    m = F.col("motif")
    return loci(spark, sf_dir).select(
        "locus", F.upper(m).alias("motif"), Q.revcomp(m).alias("revcomp"), Q.on_strand(m, F.col("strand")).alias("gene_motif"), F.array_join(Q.rotations(m), ",").alias("rotations")
    )


_DNA = "translate(md5(cast(locus as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _structure(spark, sf_dir) -> DataFrame:
    dna = F.translate(F.md5(F.col("locus").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return loci(spark, sf_dir).withColumn("dna", dna)


@query(
    f"""with {LOCI}, s as (select locus, {_DNA} as dna from loci), p as (select locus, k, dna[k:k] as c, dna[k-1:k-1] as b from s, range(1, 33) r(k)),
    g as (select locus, k, c, sum(case when k = 1 or c <> b then 1 else 0 end) over (partition by locus order by k) as run from p)
    select locus, string_agg(c || cast(n as varchar), '' order by run) as rle from (select locus, run, min(c) as c, count(*) as n from g group by locus, run) group by locus"""
)
def run_length(spark, sf_dir) -> DataFrame:
    code = F.transform(Q.run_lengths(F.col("dna")), lambda r: F.concat(r["label"], r["n"].cast("string")))
    return _structure(spark, sf_dir).select("locus", F.array_join(code, "").alias("rle"))


@query(
    f"""with {LOCI}, s as (select locus, unit_len, repeat(motif, 4) || {_DNA} as seq from loci)
    select locus, cast(list_sum(list_transform(range(1, length(seq) - unit_len + 1), lambda i: case when seq[i:i] = seq[i + unit_len:i + unit_len] then 1 else 0 end)) as bigint) as at_unit,
    cast(list_sum(list_transform(range(1, length(seq) - unit_len), lambda i: case when seq[i:i] = seq[i + unit_len + 1:i + unit_len + 1] then 1 else 0 end)) as bigint) as at_next from s"""
)
def competing_period(spark, sf_dir) -> DataFrame:
    seq = F.concat(F.repeat("motif", F.lit(4)), F.col("dna"))
    d = _structure(spark, sf_dir).withColumn("seq", seq)
    lag = lambda k: Q.lag_matches(F.col("seq"), F.col("unit_len") + k).cast("long")
    return d.select("locus", lag(0).alias("at_unit"), lag(1).alias("at_next"))


_METH = f"""{CALLS}, sites as (select locus, hp, strand, meth as pm, (1 - meth) * conf * 5 as ph, case when conf < 0.03 then 'up' when conf < 0.06 then 'tract' else 'down' end as win from calls),
called as (select *, case when greatest(greatest(1 - pm - ph, 0), pm, ph) < 0.8 then 'fail' when pm >= greatest(greatest(1 - pm - ph, 0), ph) then 'm'
  when ph >= greatest(1 - pm - ph, 0) then 'h' else 'C' end as call,
  case when greatest(1 - pm - ph / 2, pm + ph / 2) < 0.8 then 'fail' when pm + ph / 2 >= 1 - pm - ph / 2 then 'm' else 'C' end as ignored from sites)"""


def _sites(spark, sf_dir) -> DataFrame:
    m, c = F.col("meth"), F.col("conf")
    win = F.when(c < 0.03, "up").when(c < 0.06, "tract").otherwise("down")
    return calls(spark, sf_dir).select("locus", "hp", "strand", m.alias("pm"), ((1 - m) * c * 5).alias("ph"), win.alias("win"))


@query(f"with {_METH} select locus, call, ignored, count(*) as n from called group by locus, call, ignored")
def mod_call_conventions(spark, sf_dir) -> DataFrame:
    p = F.col("pm"), F.col("ph")
    called = _sites(spark, sf_dir).select("locus", C.modification_call(*p, 0.8).alias("call"), C.modification_call(*p, 0.8, "ignore_h").alias("ignored"))
    return called.groupBy("locus", "call", "ignored").agg(F.count("*").alias("n"))


@query(
    f"""with {_METH} select locus, hp, win, round(avg(pm), 6) as mean_p, count(*) as n, count(case when call <> 'fail' then 1 end) as n_valid,
    count(case when call = 'm' then 1 end) as n_mod, count(case when call = 'fail' then 1 end) as n_fail, count(case when call = 'h' then 1 end) as n_hydroxy,
    round(count(case when call = 'm' then 1 end) / nullif(cast(count(case when call <> 'fail' then 1 end) as double), 0), 6) as frac from called group by locus, hp, win"""
)
def methylation_window(spark, sf_dir) -> DataFrame:
    from ..operators.methylation import window_counts

    w = window_counts(_sites(spark, sf_dir), ["locus", "hp", "win"])
    return w.select("locus", "hp", "win", F.round("mean", 6).alias("mean_p"), "n", "n_valid", "n_mod", "n_fail", "n_hydroxy", F.round("frac", 6).alias("frac"))


@query(
    f"""with {_METH}, w as (select locus, hp, strand, count(case when call <> 'fail' then 1 end) as n_valid, count(case when call = 'm' then 1 end) as n_mod,
      count(*) as n, count(case when call = 'fail' then 1 end) as n_fail, count(case when call = 'h' then 1 end) as n_hydroxy from called where win = 'tract' group by locus, hp, strand),
    f as (select *, n_mod / nullif(cast(n_valid as double), 0) as frac, n_hydroxy / nullif(cast(n_valid as double), 0) as hyd, n_fail / cast(n as double) as fail from w)
    select locus, hp, round(avg(frac), 6) as meth_mean, round(sum(case when n_valid > 0 then n_mod end) / nullif(cast(sum(n_valid) as double), 0), 6) as pooled, round(avg(hyd), 6) as hydroxy, round(avg(fail), 6) as fail_frac,
    round(avg(case when n_valid >= 3 then case when frac >= 0.5 then cast(1 as double) else cast(0 as double) end end), 6) as gt50 from f group by locus, hp"""
)
def methylation_pooled(spark, sf_dir) -> DataFrame:
    from ..operators.methylation import allele_methylation, window_counts

    tract = window_counts(_sites(spark, sf_dir).where("win = 'tract'"), ["locus", "hp", "strand"])
    m = allele_methylation(tract, ["locus", "hp"])
    return m.select("locus", "hp", *[F.round(c, 6).alias(c) for c in ("meth_mean", "pooled", "hydroxy", "fail_frac", "gt50")])


@query(
    f"""with {CALLS}, good as (select locus, hp, count(*) as n, median(units) as centre from calls where hp > 0 group by locus, hp having count(*) >= 3),
    both_ as (select locus from good group by locus having count(*) = 2),
    cells as (select c.locus, c.hp, c.units, count(*) as n from calls c join both_ using (locus) group by c.locus, c.hp, c.units),
    near as (select c.*, g.hp as g, g.centre, row_number() over (partition by c.locus, c.hp, c.units order by case when c.hp = g.hp then 0 when c.hp > 0 then 2 else 1 end, abs(c.units - g.centre), g.hp) as k
      from cells c join good g using (locus)),
    lab as (select *, case when hp > 0 or abs(units - centre) <= greatest(2, 0.1 * centre) then g end as h from near where k = 1),
    rank as (select g.locus, g.hp, row_number() over (partition by g.locus order by g.centre, g.hp) as allele, g.centre from good g join both_ using (locus))
    select r.locus, cast(r.allele as int) as allele, r.centre as median, cast(r.hp as int) as hp, cast(coalesce(sum(l.n), 0) as bigint) as support
    from rank r left join lab l on l.locus = r.locus and l.h = r.hp group by r.locus, r.allele, r.centre, r.hp"""
)
def hp_alleles(spark, sf_dir) -> DataFrame:
    """The branch of haplotype tags alone, as its SQL has it: the least support, twice a locus's
    reads, keeps the test for an allele that the tags miss from ever passing."""
    cells = stats.histogram(calls(spark, sf_dir), ["locus", "hp"], "units")
    good = cells.where("hp > 0").groupBy("locus", "hp").agg(F.sum("n").alias("r")).where("r >= 3").groupBy("locus").count().where("count = 2").select("locus")
    assigned = assign_alleles(cells.join(good, "locus", "left_semi").withColumn("ploidy", F.lit(2)), S.Options(min_frac=2.0))
    return assigned.where("allele >= 0").groupBy("locus", "allele", "median", F.col("allele_hp").alias("hp")).agg(F.sum("n").alias("support"))


@query()
def gmm_alleles(spark, sf_dir) -> DataFrame:
    cells = stats.histogram(calls(spark, sf_dir), ["locus"], "units").withColumns({"hp": F.lit(0), "ploidy": F.lit(2)})
    assigned = assign_alleles(cells, S.Options(use_hp=False))
    return assigned.where("allele >= 0").groupBy("locus", "allele", "median", "method").agg(F.sum("n").alias("support"))


@query(
    f"""with {CALLS}, {LOCI}, s as (select locus, unnest([cast(units as bigint), cast(units as bigint) * 2, 3]) as off, cast(round(meth * 100) as bigint) as pct from calls)
    select s.locus, cast(floor(s.off / cast(l.unit_len as double)) as int) as unit, count(*) as n, round(avg(s.pct / cast(100 as double)), 6) as mean from s join loci l using (locus) group by s.locus, cast(floor(s.off / cast(l.unit_len as double)) as int)"""
)
def methylation_by_unit(spark, sf_dir) -> DataFrame:
    from ..operators.methylation import by_unit

    u, pct = F.col("units").cast("long"), F.round(F.col("meth") * 100).cast("long")
    listed = F.concat_ws(",", *[F.concat_ws(":", off.cast("string"), pct.cast("string")) for off in (u, u * 2, F.lit(3))])
    rows = calls(spark, sf_dir).select("locus", listed.alias("cpg_5mc")).join(loci(spark, sf_dir).select("locus", "unit_len"), "locus")
    return by_unit(rows, ["locus"]).select("locus", "unit", "n", F.round("mean", 6).alias("mean"))
