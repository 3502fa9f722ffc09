import json

import pytest
from synthetic import CATALOG, CONTIG, COPIES, END, LOCUS, MOTIF, REF, SIZE, START

from repeatloom.sources import catalog, fasta


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("fasta") / "ref.fa"
    lines = [REF[k : k + 80] for k in range(0, len(REF), 80)]
    p.write_text(f">{CONTIG}\n" + "\n".join(lines) + "\n")
    (p.parent / "ref.fa.fai").write_text(f"{CONTIG}\t{len(REF)}\t6\t80\t81\n")
    return p


def test_slices(path):
    f = fasta.Fasta(str(path))
    assert f.fetch(CONTIG, START, END) == MOTIF * COPIES and f.fetch(CONTIG, 75, 165) == REF[75:165] and f.fetch(CONTIG, -5, 3) == REF[:3] and f.fetch(CONTIG, 9000, 9100) == ""


def test_names():
    assert fasta.resolve({"chr1", "MT"}, "1") == "chr1" and fasta.resolve({"1"}, "chr1") == "1" and fasta.resolve({"MT"}, "chrM") == "MT" and fasta.resolve({"2"}, "chr1") is None


def test_annotation_and_checks(spark, path, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(CATALOG))
    loci = fasta.annotate(catalog.load(spark, f"file://{tmp_path}/c.json"), str(path))
    r = {x.id: x for x in loci.collect()}
    assert r[LOCUS].ref_tract == MOTIF * COPIES and r[LOCUS].ref_pad == "A" and tuple(r[LOCUS].period) == (0, 0) and r["NO_READS"].ref_tract is None
    assert {x.id: x.cover for x in fasta.cover_by_motif(loci).collect()} == {LOCUS: 1.0} and not fasta.build_suspect(loci)
    alignment = spark.createDataFrame([(CONTIG, SIZE), ("ctgB", 100)], "contig string, length long")
    assert {x.id for x in fasta.mismatched(loci, alignment, fasta.contigs(spark, str(path))).collect()} == {"NO_READS"}
