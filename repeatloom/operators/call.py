"""Alleles, summaries and the per-locus table from reads' unit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import classify as C
from ..functions import text as X
from ..kernels import alleles as K
from ..storage import cut
from . import stats

#: Loci whose mixtures are fitted at once.
TOGETHER = 512
_OUT = "{key} {kind}, hp int, value double, n long, allele int, median double, allele_hp int, minor boolean, method string, notes string"


def assign_alleles(cells: DataFrame, options: S.Options = S.Options(), key: str = "locus") -> DataFrame:
    """Cells (key, hp, value, n, ploidy) with their allele (from 1 by size; -1 for none),
    its median, tag and whether it is a minor mode, and the locus's method and notes.

    A locus is as large as its distinct (size, tag) pairs, not as its reads. Loci are
    brought together by key and ``TOGETHER`` of them are fitted at a time.
    """
    kind = cells.schema[key].dataType.simpleString()

    def assigned(loci: list[list[tuple]], key_type: pa.DataType) -> pa.RecordBatch:
        columns = [list(zip(*rows)) for rows in loci]
        made = K.assign_many(
            [
                {"values": np.array(c[2]), "hps": np.array(c[1]), "counts": np.array(c[3]), "ploidy": int(c[4][0]), "mosaic": options.mosaic, "min_support": options.min_support, "min_frac": options.min_frac, "use_hp": options.use_hp}
                for c in columns
            ]
        )
        rows = []
        for cells_, m in zip(loci, made):
            text = "; ".join(m.notes)
            for (k, hp, value, n, _), label in zip(cells_, m.labels.tolist()):
                a = m.alleles[label] if label >= 0 else None
                rows.append((k, hp, value, n, label + 1 if a else -1, a and a.median, a and a.hp, a and a.minor, m.method, text))
        types = [key_type, pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
        data = list(zip(*rows)) if rows else [[]] * len(types)
        names = [x.split()[0] for x in _OUT.format(key=key, kind=kind).split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loci: list[list[tuple]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not loci or loci[-1][0][0] != row[0]:
                    if len(loci) >= TOGETHER:
                        yield assigned(loci, batch.schema.field(0).type)
                        loci = []
                    loci.append([])
                loci[-1].append(row)
        if loci:
            yield assigned(loci, batch.schema.field(0).type)

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, so not merged: the work is not in the bytes
    ordered = cells.select(key, F.col("hp").cast("int").alias("hp"), "value", F.col("n").cast("long").alias("n"), "ploidy").repartition(parts, key).sortWithinPartitions(key, "value", "hp")
    return ordered.mapInArrow(run, _OUT.format(key=key, kind=kind))


def summarise(assigned: DataFrame, key: str = "locus") -> DataFrame:
    """One row per (locus, allele): spread, support, dispersion."""
    keys = [key, "allele"]
    cells = assigned.where("allele > 0")
    fixed = cells.groupBy(*keys).agg(F.first("median").alias("centre"), F.first("allele_hp").alias("hp"), F.first("minor").alias("minor"), F.first("method").alias("method"), F.first("notes").alias("notes"))
    s = stats.spread(cells.select(*keys, "value", "n").groupBy(*keys, "value").agg(F.sum("n").alias("n")), keys)
    joined = s.withColumnRenamed("median", "median_measured").join(fixed, keys)
    return joined.withColumn("dispersed", C.over_dispersed(F.col("median_measured"), F.col("p95"), F.col("tail_up"), F.col("n")))


def double_homozygotes(alleles: DataFrame, ploidy: Column, key: str = "locus") -> DataFrame:
    """A single, not over-dispersed main allele of a diploid locus is given twice (``is_copy`` marks the second)."""
    main = F.col("minor") == F.lit(False)
    counts = alleles.groupBy(key).agg(F.count_if(main).alias("_main"))
    hom = (F.col("_main") == 1) & main & ~F.col("dispersed") & (ploidy == 2)
    twice = alleles.join(counts, key).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(hom, 2).otherwise(1))))
    return twice.withColumn("allele", F.when(F.col("_copy") == 2, 2).otherwise(F.col("allele"))).withColumn("is_copy", F.col("_copy") == 2).drop("_main", "_copy")


def locus_table(calls: DataFrame, loci: DataFrame, options: S.Options = S.Options()) -> DataFrame:
    """One row per locus: two alleles with their statistics and class, bound, evidence.

    calls: locus, units, hp, ``exact`` (spanning; others give lower bounds). loci: locus,
    thresholds, bands, unit_len, ploidy.
    """
    cells = stats.histogram(calls.where("exact"), ["locus", "hp"], "units").join(loci.select("locus", "ploidy"), "locus")
    assigned = cut(assign_alleles(cells, options), "assigned")  # read three times below
    alleles = double_homozygotes(summarise(assigned).join(loci.select("locus", "ploidy"), "locus"), F.col("ploidy"))
    thresholds = [F.col(c) for c in ("bmin", "bmax", "imin", "imax", "pmin", "pmax")]
    alleles = alleles.join(loci.select("locus", "bands", *thresholds), "locus").withColumn("cls", C.classify(F.col("median_measured"), F.col("bands"), *thresholds))
    one = F.struct("median_measured", "p5", "p95", "mad", F.col("n").alias("support"), "tail_up", "cls", "dispersed")
    main = F.col("minor") == F.lit(False)
    rows = alleles.groupBy("locus").agg(
        F.first("method").alias("method"),
        F.first("notes").alias("notes"),
        *[F.first(F.when(main & (F.col("allele") == k), one), ignorenulls=True).alias(f"a{k}") for k in (1, 2)],
        F.collect_list(F.when(main & ~F.col("is_copy"), F.col("median_measured"))).alias("medians"),
        F.bool_or(main & F.col("dispersed")).alias("dispersed"),
    )
    tags = calls.where("exact").groupBy("locus").agg(F.count("*").alias("n_spanning"), F.avg(F.col("hp").isin(1, 2).cast("double")).alias("tagged_fraction"))
    bounds = stats.lower_bound(stats.histogram(calls.where("not exact"), ["locus"], "units"), ["locus"])
    n_partial = calls.where("not exact").groupBy("locus").agg(F.count("*").alias("n_partial"))
    found = loci.join(rows, "locus", "left").join(tags, "locus", "left").join(bounds, "locus", "left").join(n_partial, "locus", "left")
    none = F.expr("cast(array() as array<double>)")
    zero = lambda c: F.coalesce(c, F.lit(0))
    state = C.evidence_state(F.col("bound"), zero("support"), F.coalesce("medians", none), F.col("pmin"), zero("n_partial"))
    found = found.withColumn("evidence", state).withColumn("regime", C.regime(F.col("pmax"), F.col("unit_len")))
    reliable = C.negative_reliable(F.col("evidence"), F.coalesce("dispersed", F.lit(False)), zero("n_spanning"), F.col("regime"), F.lit(None).cast("double"), options.min_support)
    return found.withColumn("negative_reliable", reliable)


def formatted(rows: DataFrame) -> DataFrame:
    """The table's text columns; missing is a dot."""
    a = lambda k, c: F.col(f"a{k}.{c}")
    alleles = []
    for k in (1, 2):
        alleles += [X.fixed(a(k, "median_measured"), 1).alias(f"a{k}_median"), X.fixed(a(k, "p5"), 1).alias(f"a{k}_p5"), X.fixed(a(k, "p95"), 1).alias(f"a{k}_p95"), X.fixed(a(k, "mad"), 3).alias(f"a{k}_mad")]
        alleles += [X.whole(a(k, "support")).alias(f"a{k}_support"), X.fixed(F.bround(a(k, "tail_up"), 6), 3).alias(f"a{k}_tail_up_frac"), X.text(a(k, "cls")).alias(f"a{k}_cls"), X.flag(a(k, "dispersed")).alias(f"a{k}_dispersed")]
    return rows.select(
        F.col("id").alias("locus"), "gene", F.col("contig").alias("chrom"), X.whole(F.col("start_pos")).alias("start"), X.whole(F.col("end_pos")).alias("end"), "regime", X.text(F.col("method")).alias("method"),
        X.whole(F.coalesce("n_spanning", F.lit(0))).alias("n_spanning"), X.whole(F.coalesce("n_partial", F.lit(0))).alias("n_partial"), *alleles,
        X.whole(F.col("bound")).alias("lower_bound_units"), X.whole(F.coalesce("support", F.lit(0))).alias("lower_bound_support"), "evidence",
        X.flag(F.col("negative_reliable")).alias("negative_reliable"), X.fixed(F.bround("tagged_fraction", 6), 2).alias("tagged_fraction"),
    )
