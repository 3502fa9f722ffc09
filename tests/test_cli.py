import json

import pytest
from synthetic import CATALOG, CONTIG, COPIES, END, LOCUS, LONG, MOTIF, REF, SHORT, START, reads

from repeatloom import cli
from repeatloom import schema as S
from repeatloom.sinks import vcf


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "c.json").write_text(json.dumps(CATALOG))
    (d / "o.yaml").write_text("sources: {s1: {kind: paper, citation: c, jurisdiction: Nowhere}}\nloci: {TOY_MOTIF: {aliases: [ZEBRA], bands: [{upper: 44, label: normal, boundary: {source: s1, section: 2.1}}, {upper: null, label: full}]}}\ndiscrepancies: [{locus: X, kind: k}]\n")
    lines = [REF[k : k + 80] for k in range(0, len(REF), 80)]
    (d / "ref.fa").write_text(f">{CONTIG}\n" + "\n".join(lines) + "\n")
    (d / "ref.fa.fai").write_text(f"{CONTIG}\t{len(REF)}\t6\t80\t81\n")
    spark.createDataFrame(reads(), S.READS).write.parquet(str(d / "SYNTH.parquet"))
    assert cli.main(["call", str(d / "SYNTH.parquet"), "--catalog", str(d / "c.json"), "--reference", str(d / "ref.fa"), "--out", str(d / "r"), "--vcf"]) == 0
    return d


def table(path):
    rows = [line.split("\t") for line in path.read_text().splitlines()]
    return rows[0], [dict(zip(rows[0], r, strict=True)) for r in rows[1:]]


def test_tables(made):
    head, rows = table(made / "r.loci.tsv")
    assert head == S.locus_header() and len(head) == 75 and [r["locus"] for r in rows] == [LOCUS, "NO_READS"]
    r = rows[0]
    assert (r["a1_median"], r["a2_median"], r["method"], r["n_spanning"], r["tagged_fraction"], r["a1_meth_tract"]) == ("14.0", "37.0", "HP", "19", "1.00", "1.000")
    assert rows[1]["a1_median"] == "." and rows[1]["method"] == "none" and rows[1]["ref_copies"] == "."
    head, rows = table(made / "r.per_read.tsv")
    assert head == S.PER_READ_COLUMNS and len(head) == 34 and len(rows) == 25
    assert {r["read_class"] for r in rows} == {"spanning", "split", "right_partial"} and rows[0]["n_total_units"] in ("14", "37")


def test_vcf(made):
    text = (made / "r.vcf").read_text().splitlines()
    assert text[0] == "##fileformat=VCFv4.5" and sum(x.startswith("##INFO") for x in text) == 18 and sum(x.startswith("##FORMAT") for x in text) == 16
    first, second = (x.split("\t") for x in text if not x.startswith("#"))
    assert first[3] == "A" + MOTIF * COPIES and first[4] == f"A{MOTIF * SHORT[0]},A{MOTIF * LONG[0]}" and first[6] == "PASS" and first[9].split(":")[0] == "1|2"
    assert second[4] == "." and second[6] == "NOREADS" and second[9].split(":")[0] == "."


def test_styles(tmp_path):
    assert set(vcf.load_styles()) == {"native", "tr", "conservative"} and vcf.get_style()["alt"] == "sequence"
    p = tmp_path / "s.yaml"
    p.write_text("styles: {a: {fileformat: '4.2', alt: sequence, info: [END], format: [GT], default: true}, b: {like: a, format: [GT, CN]}}")
    assert vcf.get_style("b", str(p))["info"] == ["END"] and "default" not in vcf.get_style("b", str(p))
    p.write_text("styles: {a: {fileformat: '4.2', alt: sequence, info: [NOPE], format: [GT]}}")
    with pytest.raises(ValueError, match="NOPE"):
        vcf.load_styles(str(p))
    with pytest.raises(ValueError):
        vcf.get_style("none")


def test_report_and_qc(made, capsys):
    page = (made / "r.html").read_text()
    assert LOCUS in page and '"read_id": "short-0"' in page
    code = cli.main(["qc", str(made / "r.loci.tsv"), "--tsv", str(made / "f.tsv"), "--strict"])
    out = capsys.readouterr().out
    assert code == 1 and "6 checks: 0 failed" in out and len((made / "f.tsv").read_text().splitlines()) == 7


def test_listings(made, capsys):
    base = ["--catalog", str(made / "c.json"), "--overlay", str(made / "o.yaml")]
    assert cli.main(["loci", *base, "--regime", "expansion"]) == 0
    assert LOCUS in capsys.readouterr().out
    assert cli.main(["bed", *base, "--flank", "50", "--locus", "zebra"]) == 0
    assert capsys.readouterr().out == f"{CONTIG}\t{START - 50}\t{END + 50}\t{MOTIF}\t{LOCUS}\n"
    cli.main(["bed", *base, "--merge", "--out", str(made / "m.bed")])
    assert capsys.readouterr().out == "" and (made / "m.bed").read_text().count("\n") == 2
    cli.main(["loci", *base])
    said = capsys.readouterr()
    assert len(said.out.splitlines()[0].split("\t")) == 19 and "ZEBRA" in said.out and "interruption CGTT" in said.err and said.err.rstrip().endswith("NO_MOTIF")
    with pytest.raises(SystemExit):
        cli.main(["bed", *base, "--locus", "nope"])
    for more, text in ((["--sources"], "paper"), (["--discrepancies"], "X\tk"), ([], "44\tnormal\tboundary\ts1\t2.1\tNowhere"), ([], "above\tfull\tnaming\t.")):
        cli.main(["provenance", "--overlay", str(made / "o.yaml"), *more])
        assert text in capsys.readouterr().out
    text = (made / "r.vcf").read_text()
    assert "##catalogue=c.json sha256:" in text and "c.json sha256:" in (made / "r.html").read_text()
    assert cli.main(["vcf-styles"]) == 0 and cli.catalogue_label(str(made / "c.json")).startswith("c.json sha256:")
