"""Command line: call, loci, bed, provenance, qc, vcf-styles."""

from __future__ import annotations

import argparse
import hashlib
import sys
import textwrap
from pathlib import Path

from . import schema as S

MARKS = {"pass": "ok  ", "warn": "WARN", "fail": "FAIL", "skip": "--  "}


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("repeatloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def uri(path: str) -> str:
    return path if "://" in path else f"file://{Path(path).resolve()}"


def catalogue_label(path: str) -> str:
    """A catalogue by name and content."""
    return f"{Path(path).name} sha256:{hashlib.sha256(Path(path).read_bytes()).hexdigest()[:16]}"


def load(spark, args):
    from .sources import catalog

    overlay = catalog.read_overlay(args.overlay) if args.overlay else None
    loci = catalog.load(spark, uri(args.catalog), args.build, overlay)
    if args.locus:
        missing = catalog.unknown_keys(loci, args.locus)
        if missing:
            sys.exit(f"unknown locus: {', '.join(missing)}")
        wanted = catalog.lookup(loci, args.locus).select("id").distinct()
        loci = loci.join(wanted, "id", "left_semi")
    return loci


def format_report(findings: list, sample: str | None = None) -> str:
    """Findings as text, a block each, and a count."""
    out = [f"QC: {sample}", ""] if sample else []
    for f in findings:
        out.append(f"{MARKS.get(f['status'], '?   ')} {f['check']}  [{f['basis']}]")
        out += textwrap.wrap(f["message"], 72, initial_indent="      ", subsequent_indent="      ")
        for d in f["detail"]:
            out += textwrap.wrap(d, 68, initial_indent="        - ", subsequent_indent="          ")
        out.append("")
    count = {k: sum(f["status"] == k for f in findings) for k in MARKS}
    out.append(f"{len(findings)} checks: {count['fail']} failed, {count['warn']} warned, {count['skip']} could not run")
    return "\n".join(out)


def cmd_call(args) -> int:
    from pyspark.sql import functions as F

    from .operators.genotype import call
    from .sinks import report, tables, vcf
    from .sources import bam, catalog, fasta

    style = vcf.get_style(args.vcf_style)  # before any work
    spark = session()
    loci, label = load(spark, args), catalogue_label(args.catalog)
    print(f"catalogue: {label}", file=sys.stderr)
    hits = [f"{r['id']} {r['class']} {r['motif']}" for r in catalog.told_motifs(loci).where(F.col("class").isin("reference", "pathogenic", "benign")).orderBy("ord").toLocalIterator()]
    if hits:
        print(f"warning: motifs not matched, as their length is not the unit's: {'; '.join(hits)}", file=sys.stderr)
    lengths: dict[str, int] = {}
    if args.reads.endswith(".bam"):
        bam.register(spark)
        reads = spark.read.format("bam").load(args.reads)
        lengths = dict(bam.header(args.reads)[1])
        sample = args.sample or bam.sample_name(args.reads)
    else:
        reads = spark.read.schema(S.READS).parquet(uri(args.reads))
        sample = args.sample or Path(args.reads).name.split(".")[0]
    if args.reference:
        if lengths:
            bad = fasta.mismatched(loci, bam.contigs(spark, args.reads), fasta.contigs(spark, uri(args.reference))).collect()
            if bad:
                sys.exit(f"reference and alignment differ at {', '.join(r['id'] for r in bad)}")
        loci = fasta.annotate(loci, args.reference, args.flank, args.margin)
        if fasta.build_suspect(loci):
            print("warning: most tracts do not hold their motif: is the reference of another build?", file=sys.stderr)
    options = S.Options(anchor=args.anchor, flank=args.flank, min_clip=args.min_clip, margin=args.margin, min_frac=args.min_frac, min_mapq=args.min_mapq, min_support=args.min_support, sex=args.sex, use_hp=not args.ignore_hp, mosaic=args.mosaic, clinical=args.clinical, meth_threshold=args.meth_threshold, meth_convention=args.meth_convention)
    made = call(reads, loci, options, sample, bam.contigs(spark, args.reads) if lengths else None)
    per_read, per_locus = tables.per_read(made["reads"], loci), tables.per_locus(made["loci"])
    tables.write_tsv(per_read, uri(f"{args.out}.per_read.tsv"), S.PER_READ_COLUMNS, ["locus_ord", "read_ord"])
    tables.write_tsv(per_locus, uri(f"{args.out}.loci.tsv"), S.locus_header(), ["ord"])
    if args.vcf:
        vcf.write(made["loci"], uri(f"{args.out}.vcf"), sample, style, lengths, label)
    again = tables.read_tsv(spark, uri(f"{args.out}.loci.tsv"))
    if not args.no_report:
        Path(f"{args.out}.html").write_text(report.build(again, tables.read_tsv(spark, uri(f"{args.out}.per_read.tsv")), sample, label))
    for r in again.orderBy("ord").toLocalIterator():
        print(f"{r['locus']}\t{r['a1_median']}/{r['a2_median']}\t{r['a1_cls']}/{r['a2_cls']}\t{r['evidence']}", file=sys.stderr)
    return 0


def cmd_loci(args) -> int:
    from .sources import catalog

    spark = session()
    loci = load(spark, args)
    if args.regime:
        loci = loci.where(f"regime = '{args.regime}'")
    shown = catalog.listing(loci)
    columns = [c for c in shown.columns if c != "ord"]
    print("\t".join(columns))
    for r in shown.orderBy("ord").toLocalIterator():
        print("\t".join(r[c] for c in columns))
    unused = [f"  {r['id']} {r['class']} {r['motif']}: {r['reason']}" for r in catalog.told_motifs(loci).orderBy("ord").toLocalIterator()]
    if unused:
        print("motifs of the catalogue that are not matched:", *unused, sep="\n", file=sys.stderr)
    out = [r["id"] for r in catalog.dropped(catalog.read_records(spark, uri(args.catalog)), args.build).orderBy("ord").toLocalIterator()]
    if out:
        print(f"left out, without an interval in {args.build} or a motif of the unit's length: {', '.join(out)}", file=sys.stderr)
    return 0


def cmd_bed(args) -> int:
    from pyspark.sql import functions as F

    from .operators.intervals import merge_intervals
    from .sources import catalog

    rows = catalog.bed(load(session(), args), args.flank)
    rows = merge_intervals(rows) if args.merge else rows.withColumn("names", F.col("name"))
    found = [f"{r['contig']}\t{r['start']}\t{r['end']}\t{r['motif']}\t{r['names']}\n" for r in rows.orderBy("contig", "start", "end").toLocalIterator()]
    if args.out:
        Path(args.out).write_text("".join(found))
    else:
        print("".join(found), end="")
    print(f"{len(found)} intervals, padded by {args.flank}{', merged' if args.merge else ''}", file=sys.stderr)
    return 0


def cmd_provenance(args) -> int:
    """Sources by kind; disagreements; or each band's boundary and name with what they rest on."""
    from .sources import catalog

    found = catalog.read_overlay(args.overlay)
    if args.sources:
        for key, s in sorted((found.get("sources") or {}).items(), key=lambda x: (str(x[1].get("kind")), x[0])):
            print(s.get("kind", "."), key, s.get("jurisdiction", "."), "open" if s.get("open_access") else "closed", " ".join(str(s.get("citation", ".")).split()), *[f"{k}:{s[k]}" for k in ("pmid", "pmcid", "doi") if s.get(k)], sep="\t")
        return 0
    rows = catalog.provenance(session(), found)
    if args.discrepancies:
        for r in rows.where("kind = 'discrepancy'").orderBy("no").toLocalIterator():
            print(r["locus"], r["section"], f"applied={r['quote']}", r["claim"], r["label"], r["source"] or ".", r["jurisdiction"] or ".", r["note"] or ".", sep="\t")
        return 0
    for r in rows.where(f"kind = 'band' and inhouse = {bool(args.inhouse)}").orderBy("locus", "no", "claim").toLocalIterator():
        upper = "above" if r["upper"] is None else f"{r['upper']:g}"
        print(r["locus"], upper, r["label"], r["claim"], r["source"] or ".", r["section"] or ".", r["jurisdiction"] or ".", r["quote"] or ".", r["note"] or ".", sep="\t")
    return 0


def cmd_qc(args) -> int:
    from .plans import qc
    from .sinks import tables

    found = [r.asDict() for r in qc.run_checks(tables.read_tsv(session(), uri(args.table))).orderBy("no").collect()]
    print(format_report(found))
    if args.tsv:
        Path(args.tsv).write_text("check\tstatus\tbasis\tmessage\tdetail\n" + "".join("\t".join([f["check"], f["status"], f["basis"], f["message"], " | ".join(f["detail"])]) + "\n" for f in found))
    return qc.exit_code(found, args.strict)


def cmd_styles(args) -> int:
    from .sinks import vcf

    for name, s in vcf.load_styles().items():
        print(name, s["fileformat"], s["alt"], "default" if s.get("default") else ".", s.get("description", "."), sep="\t")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="repeatloom", description=__doc__)
    sub = p.add_subparsers(required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--catalog", required=True)
    common.add_argument("--overlay")
    common.add_argument("--build", default="hg38", choices=S.BUILDS)
    common.add_argument("--locus", action="append", default=[])
    c = sub.add_parser("call", parents=[common])
    c.add_argument("reads", help="BAM file or Parquet table")
    c.add_argument("--out", required=True)
    c.add_argument("--reference")
    c.add_argument("--sample")
    c.add_argument("--sex", default="XX", choices=("XX", "XY"))
    c.add_argument("--min-mapq", type=int, default=20)
    c.add_argument("--min-support", type=int, default=3)
    for name, default in (("anchor", 50), ("flank", 100), ("min-clip", 50), ("margin", 12)):
        c.add_argument(f"--{name}", type=int, default=default)
    c.add_argument("--min-frac", type=float, default=0.10)
    c.add_argument("--meth-threshold", type=float, default=0.8)
    c.add_argument("--meth-convention", default="modkit", choices=("modkit", "ignore_h", "combine"))
    for flag in ("--ignore-hp", "--mosaic", "--clinical", "--vcf", "--no-report"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--vcf-style")
    c.set_defaults(run=cmd_call)
    c = sub.add_parser("loci", parents=[common])
    c.add_argument("--regime", choices=("short", "expansion"))
    c.set_defaults(run=cmd_loci)
    c = sub.add_parser("bed", parents=[common])
    c.add_argument("--flank", type=int, default=0)
    c.add_argument("--merge", action="store_true")
    c.add_argument("--out")
    c.set_defaults(run=cmd_bed)
    c = sub.add_parser("provenance")
    c.add_argument("--overlay", required=True)
    for flag in ("--sources", "--discrepancies", "--inhouse"):
        c.add_argument(flag, action="store_true")
    c.set_defaults(run=cmd_provenance)
    c = sub.add_parser("qc")
    c.add_argument("table")
    c.add_argument("--tsv")
    c.add_argument("--strict", action="store_true")
    c.set_defaults(run=cmd_qc)
    c = sub.add_parser("vcf-styles")
    c.set_defaults(run=cmd_styles)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
