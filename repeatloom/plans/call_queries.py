"""The whole dataflow over constructed alignments: catalogue records, observations, calls,
and what the writers make of them. Each locus of ``part`` has reads of two alleles of
known size, two that end in the tract, and one that is split over it, so that SQL can say
every result."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import genotype, intervals
from ..sinks import report, tables, vcf
from ..sources import catalog

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Aligned bases beside the tract, of a sequence that repeats no motif.
SIDE = 160
_R = random.Random(5)
LEFT, RIGHT = ("".join(_R.choice("ACGT") for _ in range(SIDE - 3)) + "TTC", "ATA" + "".join(_R.choice("ACGT") for _ in range(SIDE - 3)))


def query(f):
    QUERIES[f.__name__] = f
    return f


def records(spark, sf_dir) -> DataFrame:
    """Catalogue records, as the JSON file has them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    unit = 3 + size % 4
    motif = F.element_at(F.array(*[F.lit(m) for m in ("CAG", "AAGG", "AAAAG", "GGCCTG")]), (size % 4 + 1).cast("int"))
    start = k * 3000 + 1000
    none = F.expr("cast(array() as array<string>)")
    made = {
        "id": F.concat(F.lit("L"), k.cast("string")), "gene": F.upper("p_brand"), "chrom": F.concat(F.lit("chr"), (1 + k % 22).cast("string")), "gene_strand": F.when(size % 2 == 0, "+").otherwise("-"),
        "motif_len": unit, "start_hg38": start, "stop_hg38": start + (4 + size % 7) * unit, "ref_copies": 4 + size % 7,
        "benign_min": F.when(size % 3 != 0, F.lit(5)), "benign_max": 12 + size % 10, "intermediate_min": F.when(size % 8 != 0, 13 + size % 10), "intermediate_max": F.when(size % 8 != 0, 17 + size % 10),
        "pathogenic_min": F.when(size % 13 != 0, 18 + size % 10), "pathogenic_max": F.when(size % 5 == 0, None).when(size % 11 == 0, 3).otherwise(size * 20),
        "reference_motif_reference_orientation": F.array(motif), "interruption_reference_orientation": F.when(size % 4 == 0, F.array(F.lit("CAA"), F.lit("CA"))).otherwise(none), "inheritance": F.array(F.lit("AD")),
    }
    schema = catalog.record_schema()
    columns = [made.get(f.name, none if f.dataType.typeName() == "array" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(*columns, k.alias("ord"))


def loci(spark, sf_dir) -> DataFrame:
    return catalog.from_records(records(spark, sf_dir))


def alignments(spark, sf_dir) -> DataFrame:
    """Alignment records: four reads of each allele, two partial ones, and a read in two parts."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), (3 + F.col("p_size") % 4).alias("unit"), (F.col("p_partkey") * 3000 + 1000).alias("start"), (4 + F.col("p_size") % 7).alias("copies")
    )
    p = p.withColumn("motif", F.element_at(F.array(*[F.lit(m) for m in ("CAG", "AAGG", "AAAAG", "GGCCTG")]), (F.col("size") % 4 + 1).cast("int")))
    small = 8 + F.col("size") % 5
    large = small + 6 + F.col("size") % 7
    kinds = [F.struct(F.lit(f"a{n}").alias("name"), small.alias("units"), F.lit(1).alias("hp"), F.lit(16 * (n % 2)).alias("flag")) for n in range(4)]
    kinds += [F.struct(F.lit(f"b{n}").alias("name"), large.alias("units"), F.lit(2).alias("hp"), F.lit(16 * (n // 2)).alias("flag")) for n in range(4)]
    kinds += [F.struct(F.lit(f"p{n}").alias("name"), F.when(F.col("size") % 4 == 1, 16).otherwise(40).cast("long").alias("units"), F.lit(0).alias("hp"), F.lit(0).alias("flag")) for n in range(2)]
    kinds += [F.struct(F.lit("s").alias("name"), F.lit(30).cast("long").alias("units"), F.lit(0).alias("hp"), F.lit(f).alias("flag")) for f in (0, 2048)]
    r = p.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(kinds) - 1)))).withColumn("r", F.array(*[x.cast("struct<name:string,units:bigint,hp:int,flag:int>") for x in kinds])[F.col("at")]).select("*", "r.*")
    plain = F.expr("repeat(motif, int(units))")
    tract = F.when((F.col("size") % 4 == 0) & (F.col("hp") > 0), F.concat(F.repeat("motif", F.lit(3)), F.lit("CAA"), F.expr("repeat(motif, int(units - 4))"))).otherwise(plain)
    inside, reference = F.length(tract), F.col("copies") * F.col("unit")
    part = lambda op, n: F.struct(F.lit(op).alias("op"), n.cast("int").alias("len"))
    side = F.lit(SIDE)
    through = F.when(inside > reference, F.array(part(0, side), part(1, inside - reference), part(0, reference + side))).when(inside < reference, F.array(part(0, side), part(2, reference - inside), part(0, inside + side))).otherwise(F.array(part(0, inside + 2 * side)))
    into = F.array(part(0, side), part(4, inside + F.when(F.col("name") == "s", side).otherwise(0)))
    out_of = F.array(part(4, inside + side), part(0, side))
    later = F.col("flag") == 2048
    return r.select(
        (F.col("k") * 100 + F.col("at")).alias("ord"),
        F.concat_ws("-", F.col("k").cast("string"), "name").alias("name"),
        "flag",
        F.concat(F.lit("chr"), (1 + F.col("k") % 22).cast("string")).alias("contig"),
        F.when(later, F.col("start") + reference).otherwise(F.col("start") - SIDE).alias("pos"),
        F.lit(60).alias("mapq"),
        F.when(F.col("hp") > 0, through).when(later, out_of).otherwise(into).alias("cigar"),
        F.concat(F.lit(LEFT), tract, F.when(F.substring("name", 1, 1) != "p", F.lit(RIGHT)).otherwise("")).alias("seq"),
        "hp",
        F.lit(None).cast("string").alias("mm"),
        F.lit(None).cast("array<int>").alias("ml"),
        F.lit(None).cast("int").alias("mn"),
    )


def called(spark, sf_dir) -> dict[str, DataFrame]:
    return genotype.call(alignments(spark, sf_dir), loci(spark, sf_dir), S.Options(), "sample")


@query
def call_per_locus(spark, sf_dir) -> DataFrame:
    """The 75 columns that the per-locus writer gives."""
    return tables.per_locus(called(spark, sf_dir)["loci"]).drop("ord")


@query
def call_per_read(spark, sf_dir) -> DataFrame:
    """The 34 columns that the per-read writer gives."""
    return tables.per_read(called(spark, sf_dir)["reads"], loci(spark, sf_dir)).select(*S.PER_READ_COLUMNS)


@query
def call_vcf_native(spark, sf_dir) -> DataFrame:
    return vcf.records(called(spark, sf_dir)["loci"], vcf.get_style("native")).select("line")


@query
def call_vcf_symbolic(spark, sf_dir) -> DataFrame:
    return vcf.records(called(spark, sf_dir)["loci"], vcf.get_style("tr")).select("line")


@query
def call_report_reads(spark, sf_dir) -> DataFrame:
    """Each locus's reads in the order of the review page."""
    nested = report.payload(tables.per_read(called(spark, sf_dir)["reads"], loci(spark, sf_dir)))
    row = "array<struct<read_id:string,read_class:string,allele:string,n_total_units:string,lower_bound_units:string,structure_string:string>>"
    shown = F.transform(F.from_json("reads", row), lambda x: F.concat_ws(":", x["read_id"], x["read_class"], x["allele"], x["n_total_units"], x["lower_bound_units"], x["structure_string"]))
    return nested.select("locus", F.array_join(shown, ",").alias("reads"))


@query
def call_observations(spark, sf_dir) -> DataFrame:
    """What every usable record shows at its locus."""
    found = loci(spark, sf_dir).withColumn("found_contig", F.col("contig"))
    o = genotype.observations(alignments(spark, sf_dir), genotype.complete(found))
    return o.select("locus", "ord", "name", "reverse", "mapq", "hp", "read_length", "read_class", "size_bp", "labels", "run_seq", "phase", "lower_bound")


@query
def catalog_records(spark, sf_dir) -> DataFrame:
    """Loci as the catalogue loader makes them of its records."""
    unused = F.array_join(F.transform("unused_motifs", lambda u: F.concat_ws(":", u["class"], u["motif"], u["reason"])), ";")
    return loci(spark, sf_dir).select(
        "id", "gene", "contig", "start_pos", "end_pos", "gene_strand", "unit_len", F.array_join("ref_motifs", ",").alias("ref_motifs"), "gene_motif", F.array_join("interruption_motifs", ",").alias("interruption_motifs"),
        "regime", "composition", "meth_relevant", "bmin", "bmax", "imin", "imax", "pmin", "pmax", "ref_copies", unused.alias("unused"),
    )


@query
def catalog_bed(spark, sf_dir) -> DataFrame:
    return catalog.bed(loci(spark, sf_dir), 50).drop("ord")


@query
def catalog_listing_text(spark, sf_dir) -> DataFrame:
    """The catalogue as the command line lists it."""
    return catalog.listing(loci(spark, sf_dir)).drop("ord")


@query
def catalog_unmatched(spark, sf_dir) -> DataFrame:
    """Motifs that no unit can match, and records that are left out (with an interval in the first build only)."""
    raw = records(spark, sf_dir)
    out = catalog.dropped(raw.withColumn("start_hg38", F.when(F.col("ord") % 7 != 0, F.col("start_hg38"))))
    told = catalog.told_motifs(loci(spark, sf_dir)).select("id", F.concat_ws(" ", "class", "motif", "reason").alias("told"))
    return told.unionByName(out.select("id", F.lit("dropped").alias("told")))


@query
def bed_merge_catalog(spark, sf_dir) -> DataFrame:
    """Padded intervals of the loaded catalogue, merged: neighbours on a contig are 66,000 bases apart."""
    return intervals.merge_intervals(catalog.bed(loci(spark, sf_dir), 33_000))


@query
def catalog_aliases(spark, sf_dir) -> DataFrame:
    """Loci by id, gene or alias, whatever the case."""
    over = {"loci": {"L7": {"aliases": ["Seventh", "l9"]}, "L11": {"aliases": ["eleventh"]}}}
    found = catalog.from_records(records(spark, sf_dir), "hg38", over)
    return catalog.lookup(found, ["l9", "ELEVENTH", "seventh", "brand#13", "nowhere"]).select("key", "id")


def _class(u: str) -> str:
    return f"""case when pmin is not null and pmax is not null and bmin is not null and pmax < bmin then
    case when {u} <= pmax then 'pathogenic' when {u} <= bmax and {u} >= bmin then 'benign' else 'uncertain' end
  when {u} <= bmax and (bmin is null or {u} >= bmin) then 'benign' when {u} >= imin and {u} <= imax then 'intermediate'
  when {u} >= pmin then 'pathogenic' when {u} <= bmax then 'benign' else 'uncertain' end"""


_STRUCTURE = "case when size % 4 = 0 then 'CCCI' || repeat('C', cast({0} - 4 as int)) else repeat('C', cast({0} as int)) end"
_TRACT = "case when size % 4 = 0 then repeat(motif, 3) || 'CAA' || repeat(motif, cast({0} - 4 as int)) else repeat(motif, cast({0} as int)) end"

_MADE = f"""loc as (select p_partkey as k, p_size as size, 'L' || cast(p_partkey as varchar) as id, upper(p_brand) as gene, 'chr' || cast(1 + p_partkey % 22 as varchar) as contig,
  p_partkey * 3000 + 1000 as start_pos, p_partkey * 3000 + 1000 + (4 + p_size % 7) * (3 + p_size % 4) as end_pos, case when p_size % 2 = 0 then '+' else '-' end as gene_strand, 3 + p_size % 4 as unit, 4 + p_size % 7 as copies,
  case p_size % 4 when 0 then 'CAG' when 1 then 'AAGG' when 2 then 'AAAAG' else 'GGCCTG' end as motif, 8 + p_size % 5 as u1, 14 + p_size % 5 + p_size % 7 as u2, case when p_size % 4 = 1 then 16 else 40 end as tail,
  case when p_size % 3 <> 0 then 5 end as bmin, 12 + p_size % 10 as bmax, case when p_size % 8 <> 0 then 13 + p_size % 10 end as imin, case when p_size % 8 <> 0 then 17 + p_size % 10 end as imax,
  case when p_size % 13 <> 0 then 18 + p_size % 10 end as pmin, case when p_size % 5 = 0 then null when p_size % 11 = 0 then 3 else p_size * 20 end as pmax from part),
turned as (select *, case when gene_strand = '+' then motif else reverse(translate(motif, 'ACGT', 'TGCA')) end as gene_motif,
  case when pmax is null or pmax * unit > 1000 then 'expansion' else 'short' end as regime, pmin * unit + 300 as needed from loc),
made as (select *, tail as bound, case when tail = 40 then 2 else 3 end as support, case when tail = 40 then 'EXPANSION_LB' else 'PARTIALS_PRESENT' end as evidence,
  (4 * cast(2 * {SIDE} + u1 * unit >= needed as int) + 4 * cast(2 * {SIDE} + u2 * unit >= needed as int) + 2 * cast({SIDE} + tail * unit >= needed as int) + cast(2 * {SIDE} + 30 * unit >= needed as int)) / cast(11 as double) as det,
  {_class('u1')} as c1, {_class('u2')} as c2, {_STRUCTURE.format('u1')} as s1, {_STRUCTURE.format('u2')} as s2, {_TRACT.format('u1')} as t1, {_TRACT.format('u2')} as t2 from turned),
done as (select *, case when evidence = 'EXPANSION_LB' then '0' when regime = 'short' then '1' when coalesce(det >= 0.8, false) then '1' else '0' end as negrel, case when det is null then '.' else printf('%.3f', det) end as det_text from made)"""


def _allele_sql(n: int) -> str:
    u = f"u{n}"
    one = f"printf('%.1f', cast({u} as double))"
    values = {
        "median": one, "median_measured": one, "p5": one, "p95": one, "mad": "'0.000'", "support": "'4'", "size_bp": f"cast({u} * unit as varchar)", "tail_up_frac": "'0.000'", "noise": "'0.000'",
        "n_interruption": "case when size % 4 = 0 then '1' else '0' end", "int_pos": "case when size % 4 = 0 then '4' else '.' end", "n_pathogenic": "'0'", "cls": f"c{n}", "dispersed": "'0'", "structure": f"s{n}",
    }
    return ", ".join(f"{values.get(c, chr(39) + '.' + chr(39))} as a{n}_{c}" for c in S.ALLELE_COLUMNS)


_LOCUS = {
    "sample": "'sample'", "locus": "id", "gene": "gene", "chrom": "contig", "start": "cast(start_pos as varchar)", "end": "cast(end_pos as varchar)", "gene_strand": "gene_strand", "motif_gene": "gene_motif", "motif_ref": "motif",
    "unit_len": "cast(unit as varchar)", "regime": "regime", "composition": "'0'", "ref_copies": "printf('%.1f', cast(copies as double))", "ploidy": "'2'", "method": "'HP'", "n_reads_total": "'11'", "n_spanning": "'8'", "n_split": "'1'",
    "n_partial": "'2'", "n_no_run": "'0'", "minor_modes": "'.'", "lower_bound_units": "cast(bound as varchar)", "lower_bound_support": "cast(support as varchar)", "detectability": "det_text", "evidence": "evidence", "negative_reliable": "negrel",
    "tagged_fraction": "'1.00'", "meth_convention": "'modkit'", "notes": "'.'",
}
_HEAD, _TAIL = (", ".join(f'{_LOCUS[c]} as "{c}"' for c in names) for names in (S.LOCUS_COLUMNS, S.LOCUS_TAIL_COLUMNS))
ORACLE_SQL["call_per_locus"] = f"with {_MADE} select {_HEAD}, {_allele_sql(1)}, {_allele_sql(2)}, {_TAIL} from done"

# number, name, what (1 and 2: an allele, 3: partial, 4: split), tag, flag
_KINDS = ", ".join(str(x) for x in [
    *[(n, f"a{n}", 1, 1, 16 * (n % 2)) for n in range(4)], *[(4 + n, f"b{n}", 2, 2, 16 * (n // 2)) for n in range(4)],
    (8, "p0", 3, 0, 0), (9, "p1", 3, 0, 0), (10, "s", 4, 0, 0), (11, "s", 4, 0, 2048),
])
_READS = f"""{_MADE}, kinds(nth, suffix, what, hp, flag) as (values {_KINDS}),
sized as (select *, k || '-' || suffix as name, case what when 1 then u1 when 2 then u2 when 3 then tail else 30 end as units, size % 4 = 0 and what <= 2 as broken from done, kinds),
reads as (select *, case what when 1 then s1 when 2 then s2 else repeat('C', cast(units as int)) end as labels, case what when 1 then t1 when 2 then t2 else repeat(motif, cast(units as int)) end as run_seq,
  case when what = 3 then {SIDE} else 2 * {SIDE} end + units * unit as read_length from sized)"""
_READ = {
    "locus": "id", "read_id": "name", "read_class": "case when what <= 2 then 'spanning' when what = 3 then 'left_partial' else 'split' end", "hp": "cast(hp as varchar)", "allele": "case when what <= 2 then cast(what as varchar) else '.' end",
    "strand": "case when flag = 16 then '-' else '+' end", "mapq": "'60'", "read_length": "cast(read_length as varchar)", "size_bp": "case when what = 3 then '.' else cast(units * unit as varchar) end",
    "tract_len_bp": "case when what <= 2 then cast(units * unit as varchar) else '.' end", "n_total_units": "case when what = 3 then '.' else cast(units as varchar) end", "n_canonical": "cast(units - cast(broken as int) as varchar)",
    "n_interruption": "cast(cast(broken as int) as varchar)", "n_pathogenic": "'0'", "n_benign": "'0'", "n_other": "'0'", "units_estimated": "case when what = 3 then '0' else '1' end", "lower_bound_units": "case when what <= 2 then '.' else cast(units as varchar) end",
    "interruption_motifs_observed": "case when broken then 'CAA' else '.' end", "interruption_positions": "case when broken then '4' else '.' end", "structure_string": "labels",
}
_COUNTED = {c: "'0'" for c in S.PER_READ_COLUMNS if c.startswith("n_5mc")}
ORACLE_SQL["call_per_read"] = f"with {_READS} select {', '.join((_READ | _COUNTED).get(c, chr(39) + '.' + chr(39)) + ' as ' + c for c in S.PER_READ_COLUMNS)} from reads where nth < 11"
ORACLE_SQL["call_report_reads"] = f"""with {_READS} select id as locus, string_agg(concat_ws(':', name, {_READ['read_class']}, {_READ['allele']}, {_READ['n_total_units']}, {_READ['lower_bound_units']}, labels), ',' order by units desc, name) as reads
  from reads where nth < 11 group by id"""
ORACLE_SQL["call_observations"] = f"""with {_READS} select id as locus, k * 100 + nth as ord, name, flag = 16 as reverse, 60 as mapq, hp, cast(read_length as bigint) as read_length, case when what <= 2 then 'spanning' when nth = 11 then 'right_partial' else 'left_partial' end as read_class,
  case when what <= 2 then cast(units * unit as bigint) end as size_bp, labels, run_seq, 'C' || motif as phase, case when what > 2 then units end as lower_bound from reads"""

_BOTH = "printf('%.1f,%.1f', cast(u1 as double), cast(u2 as double))"
_SPREADS = "u1 || '-' || u1 || ',' || u2 || '-' || u2"
_SIZES = "(u1 * unit) || ',' || (u2 * unit)"
ORACLE_SQL["call_vcf_native"] = f"""with {_MADE} select concat_ws(chr(9), contig, start_pos, id, 'N', 'N' || t1 || ',N' || t2, '.', 'PASS',
  concat_ws(';', 'END=' || end_pos, 'LOCUS=' || id, 'GENE=' || gene, 'MOTIF=' || gene_motif, 'REFMOTIF=' || motif, 'MOTIFLEN=' || unit, 'REGIME=' || regime, printf('REFCN=%.1f', cast(copies as double)), 'NSPAN=8', 'NSPLIT=1', 'NPART=2',
    'LB=' || bound, 'LBSUP=' || support, case when det is not null then 'DETECT=' || det_text end, 'EVIDENCE=' || evidence, 'NEGREL=' || negrel, 'METHOD=HP'),
  'GT:CN:CNR:SUP:SIZE:MAD:TAIL:NOISE:INT:INTPOS:PM:CLS:MT:MU:MD:MF',
  concat_ws(':', '1|2', {_BOTH}, {_SPREADS}, '4,4', {_SIZES}, '0.00,0.00', '0.000,0.000', '0.000,0.000', case when size % 4 = 0 then '1,1:4,4' else '0,0:.,.' end, '0,0', c1 || ',' || c2, '.,.', '.,.', '.,.', '.,.')) as line from done"""
# an allele of the reference's size is no alternative
ORACLE_SQL["call_vcf_symbolic"] = f"""with {_MADE}, alts as (select *, u1 = copies as same from done)
select concat_ws(chr(9), contig, start_pos, id, 'N', case when same then '<CNV:TR>' else '<CNV:TR>,<CNV:TR>' end, '.', 'PASS',
  concat_ws(';', case when same then 'SVLEN=0;RN=1;RUS=' || motif || ';RUL=' || unit || ';RUC=' || printf('%.1f', cast(u2 as double)) || ';RB=' || (u2 * unit) || ';CIRUC=' || printf('%.1f,%.1f', cast(u2 as double), cast(u2 as double))
    else 'SVLEN=0,0;RN=1,1;RUS=' || motif || ',' || motif || ';RUL=' || unit || ',' || unit || ';RUC=' || {_BOTH} || ';RB=' || {_SIZES} || ';CIRUC=' || printf('%.1f,%.1f,%.1f,%.1f', cast(u1 as double), cast(u1 as double), cast(u2 as double), cast(u2 as double)) end,
    'LOCUS=' || id, 'GENE=' || gene, 'REGIME=' || regime, printf('REFCN=%.1f', cast(copies as double)), 'NSPAN=8', 'NSPLIT=1', 'NPART=2', 'LB=' || bound, 'EVIDENCE=' || evidence, 'METHOD=HP'),
  'GT:CN:CNR:SUP:SIZE:CLS', concat_ws(':', case when same then '0|1' else '1|2' end, {_BOTH}, {_SPREADS}, '4,4', {_SIZES}, c1 || ',' || c2)) as line from alts"""

ORACLE_SQL["catalog_records"] = f"""with {_MADE} select id, gene, contig, start_pos, end_pos, gene_strand, unit as unit_len, motif as ref_motifs, gene_motif, case when size % 4 = 0 then 'CAA' else '' end as interruption_motifs, regime,
  false as composition, false as meth_relevant, cast(bmin as double) as bmin, cast(bmax as double) as bmax, cast(imin as double) as imin, cast(imax as double) as imax, cast(pmin as double) as pmin, cast(pmax as double) as pmax,
  cast(copies as double) as ref_copies, case when size % 4 = 0 then 'interruption:CA:2 bp against a unit of 3' else '' end as unused from done"""
ORACLE_SQL["catalog_bed"] = f'with {_MADE} select contig, greatest(start_pos - 50, 0) as start, end_pos + 50 as "end", motif, id as name from done'
ORACLE_SQL["catalog_listing_text"] = f"""with {_MADE} select id, gene, contig as chrom, cast(start_pos as varchar) as start, cast(end_pos as varchar) as "end", gene_strand as strand, gene_motif as motif_gene, motif as motif_ref, cast(unit as varchar) as unit_len,
  regime, '0' as composition, cast(bmax as varchar) as benign_max, case when imin is null then '.' else imin || '-' || imax end as intermediate, coalesce(cast(pmin as varchar), '.') as pathogenic_min, coalesce(cast(pmax as varchar), '.') as pathogenic_max,
  '0' as meth_relevant, '0' as meth_up_bp, '0' as meth_down_bp, '' as aliases from done"""
ORACLE_SQL["catalog_unmatched"] = f"""with {_MADE} select id, 'interruption CA 2 bp against a unit of 3' as told from done where size % 4 = 0 union all select id, 'dropped' from done where k % 7 = 0"""
ORACLE_SQL["bed_merge_catalog"] = f"""with {_MADE}, p as (select contig, greatest(start_pos - 33000, 0) as s, end_pos + 33000 as e, motif, id, k from done),
  o as (select *, max(e) over (partition by contig order by s, k rows between unbounded preceding and 1 preceding) as before from p),
  g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by contig order by s, k) as grp from o)
  select contig, min(s) as start, max(e) as "end", arg_min(motif, k) as motif, string_agg(id, ',' order by s, k) as names from g group by contig, grp"""
ORACLE_SQL["catalog_aliases"] = f"""with {_MADE}, names as (select id, lower(id) as name from done union all select id, lower(gene) from done union all select * from (values ('L7', 'seventh'), ('L7', 'l9'), ('L11', 'eleventh')) as v(id, name) where id in (select id from done))
select distinct w.key, n.id from names n join (values ('l9'), ('ELEVENTH'), ('seventh'), ('brand#13'), ('nowhere')) as w(key) on lower(w.key) = n.name"""
