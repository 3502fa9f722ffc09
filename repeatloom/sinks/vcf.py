"""VCF lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "."


def alt_alleles(reference: Column, alleles: Column) -> Column:
    """Distinct alleles other than the reference, in the order seen; null alleles are left out."""
    return F.array_distinct(F.filter(alleles, lambda a: a.isNotNull() & (a != reference)))


def genotype(reference: Column, alleles: Column, phased: Column) -> Column:
    """Allele numbers: 0 the reference, then the alternatives' places; a dot where missing."""
    alts = alt_alleles(reference, alleles)
    number = F.transform(alleles, lambda a: F.when(a.isNull(), MISSING).when(a == reference, "0").otherwise(F.array_position(alts, a).cast("string")))
    return F.when(phased, F.array_join(number, "|")).otherwise(F.array_join(number, "/"))


def record(chrom: Column, pos: Column, name: Column, reference: Column, alleles: Column, passed: Column, phased: Column, info: list[tuple[str, Column]], formats: list[tuple[str, Column]]) -> Column:
    """A tab-separated record. INFO drops missing entries, FORMAT prints them as dots."""
    alts = alt_alleles(reference, alleles)
    items = [F.when(v.isNotNull() & (v != MISSING), F.concat(F.lit(f"{k}="), v)) for k, v in info]
    shown = F.concat_ws(";", *items)
    return F.concat_ws(
        "\t",
        chrom,
        pos.cast("string"),
        F.coalesce(name, F.lit(MISSING)),
        reference,
        F.when(F.size(alts) > 0, F.array_join(alts, ",")).otherwise(MISSING),
        F.lit(MISSING),
        F.when(passed, "PASS").otherwise("NOREADS"),
        F.when(shown == "", MISSING).otherwise(shown),
        F.lit(":".join(["GT", *[k for k, _ in formats]])),
        F.concat_ws(":", genotype(reference, alleles, phased), *[F.coalesce(v, F.lit(MISSING)) for _, v in formats]),
    )


# Fields that a dialect may name - number, type and meaning.
INFO = {
    "END": ("1", "Integer", "End of the reference tract"), "SVLEN": ("A", "Integer", "Length of the reference tract"), "LOCUS": ("1", "String", "Catalogue id"), "GENE": ("1", "String", "Gene"),
    "MOTIF": ("1", "String", "Motif on the gene strand"), "REFMOTIF": ("1", "String", "Motif on the reference strand"), "MOTIFLEN": ("1", "Integer", "Motif length"), "REGIME": ("1", "String", "short or expansion"),
    "REFCN": ("1", "Float", "Reference copies"), "NSPAN": ("1", "Integer", "Spanning reads"), "NSPLIT": ("1", "Integer", "Split reads"), "NPART": ("1", "Integer", "Partial reads"), "LB": ("1", "Integer", "Lower bound in units"),
    "LBSUP": ("1", "Integer", "Reads at the bound"), "DETECT": ("1", "Float", "Share of reads that could span a pathogenic allele"), "EVIDENCE": ("1", "String", "Evidence of partial reads"), "NEGREL": ("1", "Integer", "1 if a normal call is reliable"),
    "METHOD": ("1", "String", "How alleles were assigned"), "MINOR": (".", "String", "Minor modes as units:support"), "RN": ("A", "Integer", "Repeat sequences in the allele"), "RUS": (".", "String", "Repeat unit"), "RUL": (".", "Integer", "Repeat unit length"),
    "RUC": (".", "Float", "Repeat unit count"), "RB": (".", "Integer", "Bases of the repeat"), "CIRUC": (".", "Float", "Interval of the unit count"),
}
FORMAT = {
    "GT": ("1", "String", "Genotype"), "CN": (".", "Float", "Median units"), "CNR": (".", "String", "Units from p5 to p95"), "SUP": (".", "Integer", "Reads"), "SIZE": (".", "Integer", "Tract length"), "MAD": (".", "Float", "Median absolute deviation of units"),
    "TAIL": (".", "Float", "Reads in an upward tail"), "NOISE": (".", "Float", "Unrecognised units"), "INT": (".", "Integer", "Interruption units"), "INTPOS": (".", "String", "Interruption positions"), "PM": (".", "Integer", "Pathogenic units"),
    "CLS": (".", "String", "Size class"), "MT": (".", "Float", "Methylation of the tract"), "MU": (".", "Float", "Methylation upstream"), "MD": (".", "Float", "Methylation downstream"), "MF": (".", "Float", "Reads methylated at one half or more"),
}


def load_styles(path: str | None = None) -> dict[str, dict]:
    """Dialects of a YAML file, ``like`` followed and fields checked."""
    from pathlib import Path

    import yaml

    raw = yaml.safe_load(Path(path or Path(__file__).with_name("styles.yaml")).read_text())["styles"]

    def resolved(name: str, seen: tuple = ()) -> dict:
        if name not in raw or name in seen:
            raise ValueError(f"no such style, or a circle: {name}")
        own = raw[name]
        base = resolved(own["like"], (*seen, name)) if "like" in own else {}
        return {k: v for k, v in base.items() if k != "default"} | own

    styles = {name: resolved(name) for name in raw}
    for name, s in styles.items():
        for kind, known in (("info", INFO), ("format", FORMAT)):
            bad = [f for f in map(str, s.get(kind) or []) if f.split("=")[-1] not in known]
            if bad:
                raise ValueError(f"style {name}: unknown {kind} fields {', '.join(bad)}")
        if s.get("alt") not in ("sequence", "cnv_tr"):
            raise ValueError(f"style {name}: alt is sequence or cnv_tr")
    return styles


def get_style(name: str | None = None, path: str | None = None) -> dict:
    styles = load_styles(path)
    if name is None:
        return next(s for s in styles.values() if s.get("default"))
    if name not in styles:
        raise ValueError(f"unknown style {name}: one of {', '.join(styles)}")
    return styles[name]


def header(style: dict, sample: str, contigs: list[tuple[str, int | None]], catalogue: str | None = None) -> list[str]:
    out = [f"##fileformat=VCFv{style['fileformat']}", "##source=repeatloom", *([f"##catalogue={catalogue}"] if catalogue else [])]
    out += [f"##contig=<ID={c},length={n}>" if n else f"##contig=<ID={c}>" for c, n in contigs]
    if style["alt"] == "cnv_tr":
        out.append('##ALT=<ID=CNV:TR,Description="Tandem repeat">')
    out.append('##FILTER=<ID=NOREADS,Description="No spanning or split reads">')
    for kind, known in (("info", INFO), ("format", FORMAT)):
        for f in style[kind]:
            number, type_, text = known[f]
            out.append(f'##{kind.upper()}=<ID={f},Number={number},Type={type_},Description="{text}">')
    return [*out, "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


def records(rows: DataFrame, style: dict) -> DataFrame:
    """Lines of called loci (as ``genotype.locus_results`` gives), with ``ord``."""
    from ..functions import text as X

    c = F.col
    symbolic = style["alt"] == "cnv_tr"
    number = lambda x, n: X.fixed(F.bround(x, 9), n)
    have = lambda name: c(name) if name in rows.columns else F.lit(None).cast("string")
    pad = F.coalesce(F.nullif(have("ref_pad"), F.lit("")), F.lit("N"))
    tract = F.coalesce(have("ref_tract"), F.lit(""))
    a = [c("a1"), c("a2")]
    called = F.filter(F.array(*a), lambda x: x.isNotNull())
    if symbolic:
        key = lambda x: F.call_function("format_number", x["reported"], F.lit("0.000"))
        reference = F.coalesce(F.call_function("format_number", c("ref_copies"), F.lit("0.000")), F.lit(""))
    else:
        key = lambda x: F.concat(pad, x["seq"])
        reference = F.concat(pad, tract)
    keys = F.transform(called, key)
    alts = alt_alleles(reference, keys)
    of_alts = F.transform(alts, lambda k: F.element_at(F.filter(called, lambda x: key(x) == k), 1))
    some = F.size(alts) > 0
    each = lambda f: F.when(some, F.array_join(F.transform(of_alts, f), ","))
    motif = F.element_at("ref_motifs", 1)
    info = {
        "END": c("end_pos").cast("string"), "SVLEN": each(lambda x: F.length(tract).cast("string")), "LOCUS": c("id"), "GENE": c("gene"), "MOTIF": c("gene_motif"), "REFMOTIF": motif, "MOTIFLEN": c("unit_len").cast("string"),
        "REGIME": c("regime"), "REFCN": number(c("ref_copies"), 1), "NSPAN": c("n_spanning").cast("string"), "NSPLIT": c("n_split").cast("string"), "NPART": c("n_partial").cast("string"), "LB": X.whole(c("bound")), "LBSUP": c("support").cast("string"),
        "DETECT": number(c("detectability"), 3), "EVIDENCE": c("evidence"), "NEGREL": X.flag(c("negative_reliable")), "METHOD": c("method"), "MINOR": F.nullif(F.replace("minor_modes", F.lit(";"), F.lit(",")), F.lit("")),
        "RN": each(lambda x: F.lit("1")), "RUS": each(lambda x: F.coalesce(x["motif"], motif)), "RUL": each(lambda x: c("unit_len").cast("string")), "RUC": each(lambda x: number(x["reported"], 1)), "RB": each(lambda x: X.whole(x["allele_bp"])),
        "CIRUC": each(lambda x: F.concat_ws(",", number(x["p5"], 1), number(x["p95"], 1))),
    }
    of = {
        "CN": lambda x: number(x["reported"], 1), "CNR": lambda x: F.concat_ws("-", number(x["p5"], 0), number(x["p95"], 0)), "SUP": lambda x: X.whole(x["n"]), "SIZE": lambda x: X.whole(x["allele_bp"]), "MAD": lambda x: number(x["mad"], 2),
        "TAIL": lambda x: number(x["tail_up"], 3), "NOISE": lambda x: number(x["noise"], 3), "INT": lambda x: X.whole(x["n_interruption"]), "INTPOS": lambda x: X.text(x["int_pos"]), "PM": lambda x: X.whole(x["n_pathogenic"]), "CLS": lambda x: X.text(x["cls"]),
        "MT": lambda x: number(x["meth_tract"], 3), "MU": lambda x: number(x["meth_up"], 3), "MD": lambda x: number(x["meth_down"], 3), "MF": lambda x: number(x["frac_meth_reads_gt50"], 3),
    }
    none = F.size(called) == 0
    formats = [(f, F.when(none, MISSING).otherwise(F.array_join(F.transform(called, of[f]), ","))) for f in style["format"] if f != "GT"]
    gt = F.when(none, MISSING).otherwise(genotype(reference, keys, c("method").startswith("HP")))
    items = F.concat_ws(";", *[F.when(info[f].isNotNull() & (info[f] != MISSING), F.concat(F.lit(f"{f}="), info[f])) for f in style["info"]])
    shown = F.transform(alts, lambda k: F.lit("<CNV:TR>")) if symbolic else alts
    line = F.concat_ws(
        "\t", c("contig"), c("start_pos").cast("string"), c("id"), pad if symbolic else reference, F.when(some, F.array_join(shown, ",")).otherwise(MISSING), F.lit(MISSING),
        F.when(c("n_spanning") + c("n_split") > 0, "PASS").otherwise("NOREADS"), F.when(items == "", MISSING).otherwise(items), F.lit(":".join(style["format"])), F.concat_ws(":", gt, *[v for _, v in formats]),
    )
    return rows.select(line.alias("line"), "ord")


def write(rows: DataFrame, path: str, sample: str, style: dict, lengths: dict[str, int] | None = None, catalogue: str | None = None) -> None:
    """A VCF file; only contigs of the loci are declared (a catalogue's, so few)."""
    from .tables import write_text

    seen = list(dict.fromkeys(r["contig"] for r in rows.orderBy("ord").select("contig").toLocalIterator()))
    body = records(rows, style).orderBy("ord").select(F.col("line").alias("value"))
    write_text(body, path, header(style, sample, [(c, (lengths or {}).get(c)) for c in seen], catalogue))
