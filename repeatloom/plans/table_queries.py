"""Output tables, quality checks, VCF records and the nested report payload, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.call import formatted, locus_table
from ..sinks import vcf
from . import qc
from .adapters import CALLS, LOCI, calls, loci
from .locus_queries import THRESHOLDS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _called(spark, sf_dir) -> DataFrame:
    """Tagged calls are spanning reads, untagged ones partial reads."""
    c = calls(spark, sf_dir).select("locus", "units", "hp", (F.col("hp") > 0).alias("exact"))
    diploid = loci(spark, sf_dir).withColumn("ploidy", F.lit(2))
    return locus_table(c, diploid)


@query()
def loci_table(spark, sf_dir) -> DataFrame:
    return formatted(_called(spark, sf_dir))


_CLASS = """case when u is null then 'no_call' when banded then case when u <= 15 then 'normal' when u <= 30 then 'grey' when u <= 1e9 then 'full' else 'no_call' end
  when pmin is not null and pmax is not null and bmin is not null and pmax < bmin then
    case when u <= pmax then 'pathogenic' when u <= bmax and u >= bmin then 'benign' else 'uncertain' end
  when u <= bmax and (bmin is null or u >= bmin) then 'benign' when u >= imin and u <= imax then 'intermediate'
  when u >= pmin then 'pathogenic' when u <= bmax then 'benign' else 'uncertain' end"""

_ALLELES = f"""{CALLS}, {LOCI}, cen as (select locus, hp, median(units) as u, count(*) as n, quantile_cont(units, 0.05) as p5, quantile_cont(units, 0.95) as p95 from calls where hp > 0 group by locus, hp having count(*) >= 3),
both_ as (select locus from cen group by locus having count(*) = 2),
num as (select c.*, row_number() over (partition by c.locus order by u, hp) as allele from cen c join both_ using (locus)),
a as (select n.locus, n.allele, n.u, n.n, n.p5, n.p95, n.hp, {_CLASS} as cls from num n join loci using (locus))"""


@query(
    f"""with {_ALLELES} select l.id as locus, l.gene, l.contig as chrom, cast(l.start_pos as varchar) as start,
    printf('%.1f', a1.u) as a1_median, printf('%.1f', a2.u) as a2_median, printf('%.1f', round(a1.p5, 6)) as a1_p5, printf('%.1f', round(a2.p95, 6)) as a2_p95,
    cast(a1.n as varchar) as a1_support, a1.cls as a1_cls, a2.cls as a2_cls
    from loci l join a a1 on a1.locus = l.locus and a1.allele = 1 join a a2 on a2.locus = l.locus and a2.allele = 2"""
)
def loci_table_text(spark, sf_dir) -> DataFrame:
    """Text columns of loci where both haplotypes are called."""
    t = _called(spark, sf_dir).where(F.col("method") == "HP")
    t = t.withColumns({"a1": F.col("a1").withField("p5", F.round(F.col("a1.p5"), 6)), "a2": F.col("a2").withField("p95", F.round(F.col("a2.p95"), 6))})
    return formatted(t).select("locus", "gene", "chrom", "start", "a1_median", "a2_median", "a1_p5", "a2_p95", "a1_support", "a1_cls", "a2_cls")


@query(
    f"""with {CALLS} select 'L' || cast(locus as varchar) as locus, cast(hp as varchar) as hp, strand, printf('%.0f', units) as n_total_units, printf('%.3f', round(meth, 6)) as frac_5mc,
    case when conf = 0 then '.' else printf('%.2f', conf) end as mean_5mc_prob, count(*) as n from calls group by all"""
)
def per_read_table(spark, sf_dir) -> DataFrame:
    c = calls(spark, sf_dir)
    rows = c.select(
        F.concat(F.lit("L"), F.col("locus").cast("string")).alias("locus"), X.whole(F.col("hp")).alias("hp"), "strand", X.fixed(F.col("units"), 0).alias("n_total_units"),
        X.fixed(F.round("meth", 6), 3).alias("frac_5mc"), X.fixed(F.when(F.col("conf") != 0, F.col("conf")), 2).alias("mean_5mc_prob"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


_ROWS = """rows as (select p_partkey as ord, case when p_partkey = 5 then 'FXS_FMR1' else 'L' || cast(p_partkey as varchar) end as locus,
  case when p_size % 9 = 0 then '1' when p_size % 9 = 1 then '.' else '2' end as ploidy,
  case when p_size % 10 = 0 then '.' else printf('%.1f', cast(p_size as double)) end as a1_median, case when p_size % 7 = 0 then '' else printf('%.1f', p_size + (p_partkey % 3) * 0.5) end as a2_median,
  printf('%.1f', cast(p_size - 1 - p_partkey % 2 as double)) as a1_p5, printf('%.1f', cast(p_size + 1 as double)) as a1_p95,
  case when p_size % 4 = 0 then 'benign' when p_size % 4 = 1 then 'pathogenic' when p_size % 4 = 2 then 'intermediate' else 'full mutation' end as a1_cls,
  case when p_partkey % 4 < 2 then 'benign' else 'pathogenic' end as a2_cls,
  case when p_partkey % 6 = 0 then '.' else printf('%.3f', (p_partkey % 100) / cast(100 as double)) end as a1_meth_up, printf('%.3f', (p_partkey % 50) / cast(100 as double)) as a2_meth_up,
  case when p_partkey % 5 = 0 then '.' else '0.500' end as a1_meth_tract, printf('%.3f', (p_partkey % 60) / cast(100 as double)) as a1_meth_fail_frac, case when p_partkey % 3 = 0 then '' else '0.250' end as a2_meth_fail_frac,
  printf('%.2f', (p_partkey % 101) / cast(100 as double)) as tagged_fraction, case when p_size % 3 = 0 then 'GMM' else 'HP' end as method,
  case when p_size % 5 = 0 then '0' when p_size % 5 = 1 then '.' else '1' end as negative_reliable, case when p_size % 17 = 0 then '1' else '0' end as a1_dispersed, '0' as a2_dispersed,
  case when p_partkey % 29 = 0 then 'EXPANSION_LB' else 'NONE' end as evidence from part)"""


def result_rows(spark, sf_dir) -> DataFrame:
    """A per-locus table as text, with every kind of missing mark, made from ``part``."""
    k, size = F.col("p_partkey"), F.col("p_size")
    lit = F.lit
    pick = lambda x, n, *v: F.element_at(F.array(*[lit(i) for i in v]), (x % n + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("ord"),
        F.when(k == 5, "FXS_FMR1").otherwise(F.concat(lit("L"), k.cast("string"))).alias("locus"),
        F.when(size % 9 == 0, "1").when(size % 9 == 1, ".").otherwise("2").alias("ploidy"),
        F.when(size % 10 == 0, ".").otherwise(X.fixed(size, 1)).alias("a1_median"),
        F.when(size % 7 == 0, "").otherwise(X.fixed(size + (k % 3) * 0.5, 1)).alias("a2_median"),
        X.fixed(size - 1 - k % 2, 1).alias("a1_p5"),
        X.fixed(size + 1, 1).alias("a1_p95"),
        pick(size, 4, "benign", "pathogenic", "intermediate", "full mutation").alias("a1_cls"),
        F.when(k % 4 < 2, "benign").otherwise("pathogenic").alias("a2_cls"),
        F.when(k % 6 == 0, ".").otherwise(X.fixed((k % 100) / 100, 3)).alias("a1_meth_up"),
        X.fixed((k % 50) / 100, 3).alias("a2_meth_up"),
        F.when(k % 5 == 0, ".").otherwise("0.500").alias("a1_meth_tract"),
        X.fixed((k % 60) / 100, 3).alias("a1_meth_fail_frac"),
        F.when(k % 3 == 0, "").otherwise("0.250").alias("a2_meth_fail_frac"),
        X.fixed((k % 101) / 100, 2).alias("tagged_fraction"),
        F.when(size % 3 == 0, "GMM").otherwise("HP").alias("method"),
        F.when(size % 5 == 0, "0").when(size % 5 == 1, ".").otherwise("1").alias("negative_reliable"),
        F.when(size % 17 == 0, "1").otherwise("0").alias("a1_dispersed"),
        lit("0").alias("a2_dispersed"),
        F.when(k % 29 == 0, "EXPANSION_LB").otherwise("NONE").alias("evidence"),
    )


def _checked(f):
    def run(spark, sf_dir) -> DataFrame:
        found = f(result_rows(spark, sf_dir))
        return found.select("check", "status", "basis", "message", F.array_join("detail", "|").alias("detail"))

    return run


for _check in qc.CHECKS:
    QUERIES[f"qc_{_check.__name__}"] = _checked(_check)

_P1 = "printf('%.1f', {} )"
_num = lambda c: f"try_cast(nullif(nullif({c}, '.'), '') as double)"
ORACLE_SQL |= {
    "qc_modifications_present": f"""with {_ROWS}, g as (select count(case when {_num('a1_meth_tract')} is not null or {_num('a1_meth_up')} is not null then 1 end) as n, count(*) as loci from rows)
      select 'modifications_present' as "check", case when loci = 0 then 'skip' when n = 0 then 'fail' else 'pass' end as status, 'mechanical' as basis, printf('methylation at %d of %d loci', n, loci) as message, '' as detail from g""",
    "qc_modcall_confidence": f"""with {_ROWS}, v as (select {_num('a1_meth_fail_frac')} as v from rows union all select {_num('a2_meth_fail_frac')} from rows), g as (select avg(v) as mean, max(v) as worst from v where v is not null)
      select 'modcall_confidence' as "check", case when mean > 0.5 then 'warn' else 'pass' end as status, 'heuristic' as basis, printf('discarded calls: mean %.1f %%, worst %.1f %%', 100 * mean, 100 * worst) as message, '' as detail from g""",
    "qc_x_inactivation": f"""with {_ROWS}, r as (select {_num('a1_meth_up')} as m1, {_num('a2_meth_up')} as m2, coalesce(nullif({_num('ploidy')}, 0), 2) as pl, lower(a1_cls) as cls from rows where locus = 'FXS_FMR1')
      select 'x_inactivation' as "check", case when m1 is null then 'skip' when pl = 1 and contains(cls, 'path') then 'skip' when pl = 1 and m1 > 0.2 then 'warn' when pl = 1 then 'pass' when m2 is null then 'skip' when m1 = m2 then 'warn' else 'pass' end as status,
      case when pl <> 1 and m1 = m2 then 'consistency' else 'biology' end as basis,
      case when m1 is null then 'no promoter methylation' when pl = 1 and contains(cls, 'path') then 'one X, expanded: no control' when pl = 1 then printf('one X, promoter %.1f %%', 100 * m1)
      when m2 is null then 'two X, one allele measured' else printf('two X, promoter %.1f %% and %.1f %%, apart by %.1f', 100 * m1, 100 * m2, 100 * abs(m1 - m2)) end as message, '' as detail from r""",
    "qc_per_allele_attribution": f"""with {_ROWS}, g as (select avg({_num('tagged_fraction')}) as mean, count(case when method like 'GMM%' then 1 end) as gmm, count(*) as loci from rows)
      select 'per_allele_attribution' as "check", case when mean < 0.5 or gmm = loci then 'warn' else 'pass' end as status, case when mean < 0.5 then 'heuristic' else 'consistency' end as basis,
      printf('tagged %.1f %%, %d of %d loci without tags', 100 * mean, gmm, loci) as message, '' as detail from g""",
    "qc_zygosity_margin": f"""with {_ROWS}, v as (select ord, locus, {_num('a1_median')} as a1, {_num('a2_median')} as a2, {_num('a1_p5')} as p5, {_num('a1_p95')} as p95, a1_cls, a2_cls, coalesce(nullif({_num('ploidy')}, 0), 2) >= 2 as ok from rows),
      m as (select *, ok and a1 <> a2 and abs(a2 - a1) <= 1 and a1_cls <> a2_cls as nearby, ok and a1 = a2 and p95 - p5 > 2 as wide, ok and a1 <> a2 and abs(a2 - a1) <= 1 and a1_cls = a2_cls as close from v),
      t as (select ord, case when nearby then printf('%s: %g/%g, apart by %g, %s and %s', locus, a1, a2, abs(a2 - a1), a1_cls, a2_cls) else printf('%s: %g/%g, reads span %g-%g', locus, a1, a2, p5, p95) end as text from m where nearby or wide),
      g as (select count(case when nearby or wide then 1 end) as n, count(case when close then 1 end) as c from m)
      select 'zygosity_margin' as "check", case when n > 0 then 'warn' else 'pass' end as status, 'heuristic' as basis, printf('%d calls may change, %d close in one class', n, c) as message,
      (select string_agg(text, '|' order by ord) from (select * from t order by ord limit 20)) || case when n > 20 then '|...' else '' end as detail from g""",
    "qc_negative_evidence": f"""with {_ROWS}, s as (select * from rows where negative_reliable not in ('', '.')), g as (select count(case when negative_reliable = '0' then 1 end) as n, count(*) as loci from s)
      select 'negative_evidence' as "check", case when n > 0 then 'warn' else 'pass' end as status, 'consistency' as basis, printf('%d of %d loci support a negative', loci - n, loci) as message,
      (select string_agg(locus, '|' order by ord) from (select * from s where negative_reliable = '0' order by ord limit 20)) || case when n > 20 then '|...' else '' end as detail from g""",
}


@query(
    f"""with {_ROWS} select locus, case when contains(a1_cls, 'path') or contains(a2_cls, 'path') or evidence = 'EXPANSION_LB' or a1_dispersed = '1' then 'finding'
    when a1_cls in ('intermediate', 'uncertain') or a2_cls in ('intermediate', 'uncertain') then 'check'
    when {_num('a1_median')} <> {_num('a2_median')} and abs({_num('a2_median')} - {_num('a1_median')}) <= 1 and a1_cls <> a2_cls then 'check'
    when negative_reliable = '0' then 'uninformative' else 'normal' end as tier from rows"""
)
def worklist_tier(spark, sf_dir) -> DataFrame:
    return result_rows(spark, sf_dir).select("locus", qc.tier().alias("tier"))


@query(
    f"""with {_ALLELES} select l.contig || chr(9) || cast(l.start_pos as varchar) || chr(9) || l.id || chr(9) || 'N' || chr(9) || case when a1.u = a2.u then '<R' || printf('%.1f', a1.u) || '>' else '<R' || printf('%.1f', a1.u) || '>,<R' || printf('%.1f', a2.u) || '>' end
    || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'END=' || cast(l.end_pos as varchar) || ';RU=' || l.motif || chr(9) || 'GT:RC:CL' || chr(9) || case when a1.u = a2.u then '1|1' else '1|2' end || ':' || printf('%.1f', a1.u) || ',' || printf('%.1f', a2.u) || ':' || a1.cls || ',' || a2.cls as line
    from loci l join a a1 on a1.locus = l.locus and a1.allele = 1 join a a2 on a2.locus = l.locus and a2.allele = 2"""
)
def vcf_records(spark, sf_dir) -> DataFrame:
    rows = _called(spark, sf_dir).where(F.col("method") == "HP")
    median = lambda k: X.fixed(F.col(f"a{k}.median_measured"), 1)
    keys = F.array(*[F.concat(F.lit("<R"), median(k), F.lit(">")) for k in (1, 2)])
    line = vcf.record(
        chrom=F.col("contig"), pos=F.col("start_pos"), name=F.col("id"), reference=F.lit("N"), alleles=keys, passed=F.lit(True), phased=F.lit(True),
        info=[("END", F.col("end_pos").cast("string")), ("RU", F.col("motif"))],
        formats=[("RC", F.concat_ws(",", median(1), median(2))), ("CL", F.concat_ws(",", "a1.cls", "a2.cls"))],
    )
    return rows.select(line.alias("line"))


@query(
    f"""with {CALLS}, {LOCI}, g as (select locus, hp, count(*) as n, round(sum(units), 3) as total from calls group by locus, hp)
    select l.id, '[' || string_agg(printf('{{"hp":%d,"n":%d,"total":%.1f}}', g.hp, g.n, g.total), ',' order by g.hp) || ']' as payload from g join loci l using (locus) group by l.id"""
)
def nested_payload(spark, sf_dir) -> DataFrame:
    g = calls(spark, sf_dir).groupBy("locus", "hp").agg(F.count("*").alias("n"), F.round(F.sum("units"), 3).alias("total"))
    nested = g.groupBy("locus").agg(F.sort_array(F.collect_list(F.struct("hp", "n", "total"))).alias("reads"))
    return nested.join(loci(spark, sf_dir).select("locus", "id"), "locus").select("id", F.to_json("reads").alias("payload"))
