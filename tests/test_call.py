import json

import pytest
from pyspark.sql import functions as F
from synthetic import AFTER, BEFORE, CATALOG, CONTIG, END, LEAD, LOCUS, LONG, MOTIF, REF, SHORT, SPLIT, START, TAIL, reads

from repeatloom import schema as S
from repeatloom.kernels import geometry as G
from repeatloom.operators.genotype import call
from repeatloom.sources import catalog


@pytest.fixture(scope="module")
def loci(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "catalog.json"
    path.write_text(json.dumps(CATALOG))
    return catalog.load(spark, f"file://{path}")


@pytest.fixture(scope="module")
def called(spark, loci):
    made = call(spark.createDataFrame(reads(), S.READS).repartition(3), loci, S.Options(), "SYNTH")
    return {k: v.cache() for k, v in made.items()}


def test_catalogue(loci):
    rows = {r.id: r for r in loci.collect()}
    assert set(rows) == {LOCUS, "NO_READS"}  # a record without a motif of the unit's length is dropped
    assert rows[LOCUS].regime == "expansion" and not rows[LOCUS].composition and rows[LOCUS].interruption_motifs == ["CGGTT"]
    assert rows["NO_READS"].composition and rows["NO_READS"].gene_motif == "GCCTAA"


def test_derived_columns(spark, tmp_path):
    rec = {"id": "A", "gene": "g", "chrom": "chr1", "gene_strand": "-", "motif_len": 5, "start_hg38": 100, "stop_hg38": 150, "reference_motif_reference_orientation": ["AAAAG"], "pathogenic_motif_reference_orientation": ["AAGGG", "AAAGGG", "AAAAGAAAAG"], "interruption_reference_orientation": ["AAG"]}
    (tmp_path / "c.json").write_text(json.dumps([rec | {"gene": "old"}, rec]))
    over = {"loci": {"A": {"methylation": {"relevant": True, "up_bp": 30, "down_bp": 20}, "interruptions_in_size": False, "caveats": ["c"]}}}
    plain = catalog.load(spark, f"file://{tmp_path}/c.json").first()
    rich = catalog.load(spark, f"file://{tmp_path}/c.json", overlay=over).first()
    assert plain.gene == "g" and plain.composition and plain.other_periods == [6] and plain.interruptions_in_size and plain.up_window is None and not plain.meth_relevant
    assert [(u["class"], u.motif) for u in plain.unused_motifs] == [("pathogenic", "AAAGGG"), ("pathogenic", "AAAAGAAAAG"), ("interruption", "AAG")]
    assert tuple(rich.up_window) == (150, 180) and tuple(rich.down_window) == (80, 100) and rich.meth_relevant and not rich.interruptions_in_size and rich.interruption_motifs == []
    assert catalog.dropped_motifs(catalog.load(spark, f"file://{tmp_path}/c.json")).count() == 2
    with pytest.raises(ValueError):
        catalog.load(spark, f"file://{tmp_path}/c.json", "hg99")


def test_overlay(loci):
    over = {"loci": {LOCUS: {"aliases": ["ZEBRA"], "interruptions_gene": ["CGCTT"], "bands": [{"upper": 44, "label": "normal"}, {"upper": None, "label": "full mutation"}]}}}
    r = {x.id: x for x in catalog.with_overlay(loci, over).collect()}[LOCUS]
    assert r.aliases == ["ZEBRA"] and r.interruption_motifs == ["CGCTT"] and r.unused_interruptions == ["CGGTT", "CGTT"] and r.bands[1].label == "full mutation"
    found = catalog.lookup(catalog.with_overlay(loci, over), ["zebra", "toy2"])
    assert {(x.id, x.key) for x in found.collect()} == {(LOCUS, "zebra"), ("NO_READS", "toy2")}
    assert catalog.unknown_keys(loci, ["TOY1", "nope"]) == ["nope"]


def test_reads(called):
    rows = {(r.name, r.read_class): r for r in called["reads"].collect()}
    kinds = [k for _, k in rows]
    assert (kinds.count("spanning"), kinds.count("right_partial"), kinds.count("split")) == (SHORT[1] + LONG[1], TAIL[1], SPLIT[1]) and len(kinds) == 25
    for (name, kind), r in rows.items():
        if kind == "spanning":
            assert (r.units, r.allele) == ((SHORT[0], 1) if name.startswith("short") else (LONG[0], 2))
            assert r.tract.n == r.units and r.tract.frac == (r.allele == 1)  # a cytosine a unit, on both strands
        elif kind == "split":
            assert r.units == SPLIT[0] and r.allele is None
        else:
            assert r.lower_bound == TAIL[0] and r.units is None


def test_locus_row(called):
    rows = {r.id: r for r in called["loci"].collect()}
    r = rows[LOCUS]
    assert r.method == "HP" and (r.n_reads, r.n_spanning, r.n_split, r.n_partial, r.n_no_run) == (25, 19, 2, 4, 0)
    assert (r.a1.median, r.a2.median, r.a1.cls, r.a2.cls) == (SHORT[0], LONG[0], "benign", "intermediate")
    assert r.a1.structure == "C" * SHORT[0] and r.a2.seq == MOTIF * LONG[0] and r.a1.meth_tract == 1 and r.a2.meth_tract_pooled == 0
    assert (r.bound, r.support, r.evidence, r.negative_reliable) == (SPLIT[0], SPLIT[1], "EXPANSION_LB", False)
    needed = 51 * len(MOTIF) + 2 * (100 + 50)
    assert r.tagged_fraction == 1 and r.detectability == pytest.approx(sum(len(x[7]) >= needed for x in {y[1]: y for y in reads()[:-3]}.values()) / 25)
    empty = rows["NO_READS"]
    assert empty.method == "none" and empty.a1 is None and empty.notes == "no spanning or split reads" and empty.evidence == "NONE"


def test_partitioning_changes_nothing(spark, loci, called):
    again = call(spark.createDataFrame(reads(), S.READS).orderBy(F.rand(3)).repartition(7), loci, S.Options(), "SYNTH")["loci"]
    assert sorted(map(str, again.collect())) == sorted(map(str, called["loci"].collect()))


def test_contig_names(spark, loci):
    named = spark.createDataFrame([("1",), ("MT",), ("chrT",)], "contig string")
    some = spark.createDataFrame([("chr1",), ("chrM",), ("T",), ("chr9",)], "contig string")
    found = {x.contig: x.found_contig for x in catalog.resolve_contigs(some, named).collect()}
    assert found == {"chr1": "1", "chrM": "MT", "T": "chrT", "chr9": None}
    bare = spark.createDataFrame(reads(), S.READS).withColumn("contig", F.concat(F.lit("chr"), "contig"))
    rows = {r.id: r for r in call(bare, loci, S.Options(), "s", spark.createDataFrame([(f"chr{CONTIG}",)], "contig string"))["loci"].collect()}
    assert rows[LOCUS].n_spanning == 19 and rows["NO_READS"].notes == "contig ctgB not in the alignment"


def test_functions_in_sql(spark):
    from repeatloom.functions import udfs

    udfs.register(spark)
    r = spark.sql("select repeat_run('ACGTTAGCAGCAGCAGCAGTTGACAT', array('CAG')) a, repeat_run(null, array('CAG')) b, competing_period(repeat('AAAGGG', 200), 5, array(6)) c, mod_sites('ACGCGTCCA', false, 'C+m,0,1;', array(10, 200)) d").first()
    assert (r.a.start, r.a.n_units, r.b.n_units, r.c, [x.qpos for x in r.d]) == (5, 4, None, 6, [1, 6])


def test_homozygote_is_given_twice(spark, loci):
    some = [r for r in reads() if r[1].startswith("short")]
    r = call(spark.createDataFrame([(*x[:8], 0, *x[9:]) for x in some], S.READS), loci)["loci"].where(F.col("id") == LOCUS).first()
    assert r.method == "GMM" and r.a1.median == r.a2.median == SHORT[0] and r.a1.n == r.a2.n == SHORT[1]


def test_geometry():
    a = G.Alignment(100, ((4, 5), (0, 50), (1, 9), (0, 50), (2, 10), (0, 20), (5, 7)), False)
    assert a.ref_end == 230 and a.read_length == 141 and a.query_edges() == (5, 134)
    assert a.at_or_after(100) == 5 and a.at_or_after(150) == 64 and a.at_or_after(205) == 114 and a.at_or_after(230) is None
    assert a.before(150) == 55 and a.before(151) == 65 and a.before(100) is None and a.before(500) == 134
    assert a.window(140, 160) == (45, 74) and a.clips == ((4, 5), (5, 7))
    assert G.Alignment(0, ((5, 3), (0, 10)), True).own_coordinate(2) == 13 - 1 - 5
    assert G.period_flanks("TTCGCGCGCGAA", 0, 4, 8, 2, 5) == (2, 2)
    assert G.size_bounds(100, 160, 50, 100, (0, 0)) == (50, 210) and G.size_bounds(100, 160, 50, 100, (60, 0)) == (39, 210)
    cigar = ((0, BEFORE + LEAD), (1, 25), (0, END - START - LEAD + AFTER))
    o = G.observe(G.Alignment(START - BEFORE, cigar, False), REF[START - BEFORE : START] + MOTIF * 14 + REF[END : END + AFTER], START, END, 50, 100, 50, 12)
    assert (o.kind, o.size_bp, o.window) == ("spanning", 70, (12, 82))
