"""The per-read and per-locus tables as text, and single-file writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import sequence as Q
from ..functions import text as X


def per_read(reads: DataFrame, loci: DataFrame) -> DataFrame:
    """The 34 text columns of every read's row, with ``locus_ord`` and ``read_ord`` to sort by."""
    place = loci.select(F.col("id").alias("locus"), F.col("ord").alias("locus_ord"), "gene_strand")
    r = reads.join(place, "locus")
    c = F.col
    label = lambda x: F.when(c("labels").isNotNull(), F.length("labels") - F.length(F.replace("labels", F.lit(x), F.lit(""))))
    spots = F.filter(F.sequence(F.lit(1), F.length("labels")), lambda i: F.substring("labels", i, F.lit(1)) == "I")
    shown = F.transform("interruptions", lambda m: Q.on_strand(m, c("gene_strand")))
    run = c("read_class") != "no_run"
    number = lambda x, n: X.fixed(F.bround(x, 9), n)
    counted = lambda x: F.when(run, X.whole(F.coalesce(x, F.lit(0)))).otherwise(X.MISSING)
    columns: dict[str, Column] = {
        "locus": c("locus"), "read_id": c("name"), "read_class": c("read_class"), "hp": X.whole(c("hp")),
        "allele": X.whole(F.when(c("allele") > 0, c("allele"))), "strand": F.when(c("reverse"), "-").otherwise("+"), "mapq": X.whole(c("mapq")), "read_length": X.whole(c("read_length")),
        "size_bp": X.whole(c("size_bp")), "tract_len_bp": X.whole(F.when(c("exact"), F.length("run_seq"))), "n_total_units": X.whole(c("units")),
        "n_canonical": X.whole(label("C")), "n_interruption": X.whole(label("I")), "n_pathogenic": X.whole(label("P")), "n_benign": X.whole(label("B")), "n_other": X.whole(label("o")),
        "units_estimated": X.flag(F.coalesce("estimated", F.lit(False))), "lower_bound_units": X.whole(F.when(~c("exact") & run, c("lower_bound"))),
        "interruption_motifs_observed": X.text(F.array_join(shown, ",")), "interruption_positions": X.text(F.when(c("labels").isNotNull(), F.array_join(F.transform(spots, lambda i: i.cast("string")), ","))),
        "structure_string": X.text(c("labels")),
        "frac_5mc": number(c("tract.frac"), 3), "n_5mc_valid": counted(c("tract.n_valid")), "n_5mc_fail": counted(c("tract.n_fail")), "mean_5mc_prob": number(c("tract.mean"), 3), "n_5mc_sites": counted(c("tract.n")), "cpg_5mc": X.text(c("per_site")),
        "frac_5mc_up": number(c("up.frac"), 3), "n_5mc_up_valid": counted(c("up.n_valid")), "n_5mc_up_fail": counted(c("up.n_fail")), "mean_5mc_up": number(c("up.mean"), 3), "n_5mc_up": counted(c("up.n")),
        "mean_5mc_down": number(c("down.mean"), 3), "n_5mc_down": counted(c("down.n")),
    }
    kind = F.when(c("read_class").isin("spanning", "no_run"), 0).otherwise(1)
    return r.select(*[columns[k].alias(k) for k in S.PER_READ_COLUMNS], "locus_ord", F.struct(kind.alias("kind"), "ord").alias("read_ord"))


def per_locus(rows: DataFrame) -> DataFrame:
    """The 75 text columns of every locus, with ``ord`` to sort by."""
    c = F.col
    number = lambda x, n: X.fixed(F.bround(x, 9), n)
    columns: dict[str, Column] = {
        "sample": c("sample"), "locus": c("id"), "gene": X.text(c("gene")), "chrom": c("contig"), "start": X.whole(c("start_pos")), "end": X.whole(c("end_pos")), "gene_strand": X.text(c("gene_strand")), "motif_gene": c("gene_motif"),
        "motif_ref": F.element_at("ref_motifs", 1), "unit_len": X.whole(c("unit_len")), "regime": c("regime"), "composition": X.flag(c("composition")), "ref_copies": number(c("ref_copies"), 1), "ploidy": X.whole(c("ploidy")), "method": c("method"),
        "n_reads_total": X.whole(c("n_reads")), "n_spanning": X.whole(c("n_spanning")), "n_split": X.whole(c("n_split")), "n_partial": X.whole(c("n_partial")), "n_no_run": X.whole(c("n_no_run")),
        "minor_modes": X.text(c("minor_modes")), "lower_bound_units": X.whole(c("bound")), "lower_bound_support": X.whole(c("support")), "detectability": number(c("detectability"), 3), "evidence": c("evidence"),
        "negative_reliable": X.flag(c("negative_reliable")), "tagged_fraction": number(c("tagged_fraction"), 2), "meth_convention": c("meth_convention"), "notes": X.text(c("notes")),
    }
    for k in (1, 2):
        a = F.col(f"a{k}")
        size = lambda x: F.when(x == 0, "0").otherwise(number(x, 1))
        columns |= {
            f"a{k}_{n}": v
            for n, v in {
                "median": size(a["reported"]), "median_measured": number(a["median"], 1), "p5": number(a["p5"], 1), "p95": number(a["p95"], 1), "mad": number(a["mad"], 3), "support": X.whole(a["n"]), "size_bp": X.whole(a["allele_bp"]),
                "tail_up_frac": number(a["tail_up"], 3), "noise": number(a["noise"], 3), "n_interruption": X.whole(a["n_interruption"]), "int_pos": X.text(a["int_pos"]), "n_pathogenic": X.whole(a["n_pathogenic"]), "cls": X.text(a["cls"]), "dispersed": X.flag(a["dispersed"]),
                "structure": X.text(a["structure"]), "meth_tract": number(a["meth_tract"], 3), "meth_tract_pooled": number(a["meth_tract_pooled"], 3), "meth_hydroxy": number(a["meth_hydroxy"], 3), "meth_fail_frac": number(a["meth_fail_frac"], 3),
                "meth_up": number(a["meth_up"], 3), "meth_up_pooled": number(a["meth_up_pooled"], 3), "meth_down": number(a["meth_down"], 3), "frac_meth_reads_gt50": number(a["frac_meth_reads_gt50"], 3),
            }.items()
        }
    return rows.select(*[F.coalesce(columns[k], F.lit(X.MISSING)).alias(k) for k in S.locus_header()], "ord")


def lines(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Tab-separated lines, to be written in order."""
    return df.orderBy(*order).select(F.concat_ws("\t", *columns).alias("value"))


def write_text(df: DataFrame, path: str, head: list[str] | None = None) -> None:
    """One text file at ``path`` of any file system, from the lines of ``df`` in their order."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = hadoop.Path(path)
    fs = out.getFileSystem(spark._jsc.hadoopConfiguration())
    part = f"{path}.parts"
    df.write.mode("overwrite").option("compression", "none").text(part)
    stream = fs.create(out, True)
    if head:
        stream.write(bytearray("".join(f"{x}\n" for x in head).encode()))
    for f in sorted((x.getPath() for x in fs.listStatus(hadoop.Path(part)) if x.getPath().getName().startswith("part-")), key=lambda x: x.getName()):
        source = fs.open(f)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, spark._jsc.hadoopConfiguration(), False)
        source.close()
    stream.close()
    fs.delete(hadoop.Path(part), True)


def write_tsv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    write_text(lines(df, columns, order), path, ["\t".join(columns)])


def read_tsv(spark, path: str) -> DataFrame:
    """A table as written: text columns, short rows padded, with ``ord`` in file order."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="", mode="PERMISSIVE", nullValue="\0")
    return raw.fillna("").withColumn("ord", F.monotonically_increasing_id())
