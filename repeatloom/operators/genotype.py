"""From alignment records and a catalogue to the per-read, allele and locus tables.

    reads x loci (interval join) -> observations -> decomposition and methylation
      -> one observation a read (first spanning; split pairs; best partial)
      -> alleles on (size, tag) cells -> allele summaries and consensus -> locus rows

Row kernels run where the joined rows are; the shuffles are by (locus, read name), for
one observation a read, and by locus for alleles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema as S
from ..functions import classify as C
from ..kernels import basemods, consensus as cons, geometry
from ..kernels.units import Run, competing_period, motifs
from ..sources.catalog import resolve_contigs
from ..storage import cut
from . import reads as R
from . import stats
from .call import assign_alleles, double_homozygotes
from .groups import runs_of
from .intervals import interval_join

_METH = T.StructType([T.StructField(n, T.DoubleType() if n in ("mean", "frac") else T.IntegerType()) for n in ("mean", "n", "frac", "n_valid", "n_mod", "n_fail", "n_hydroxy")])
OBSERVED = T.StructType(
    [
        T.StructField("locus", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("reverse", T.BooleanType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("hp", T.IntegerType()),
        T.StructField("read_length", T.LongType()),
        T.StructField("read_class", T.StringType()),
        T.StructField("has_segment", T.BooleanType()),
        T.StructField("size_bp", T.LongType()),
        T.StructField("edge", T.LongType()),
        T.StructField("labels", T.StringType()),
        T.StructField("run_seq", T.StringType()),
        T.StructField("run_units", T.ArrayType(T.IntegerType())),
        T.StructField("phase", T.StringType()),
        T.StructField("interruptions", T.ArrayType(T.StringType())),
        T.StructField("lower_bound", T.IntegerType()),
        T.StructField("other_period", T.IntegerType()),
        T.StructField("tract", _METH),
        T.StructField("up", _METH),
        T.StructField("down", _METH),
        T.StructField("per_site", T.StringType()),
    ]
)
_LOCUS = "id start_pos end_pos unit_len ref_motifs pathogenic_motifs benign_motifs interruption_motifs up_window down_window period other_periods".split()


def methylation(sites: list[tuple[int, float, float]], window, threshold: float, convention: str) -> dict:
    """Counts of a read's calls in a query window; nothing counted without a window or sites."""
    out = {"mean": None, "n": 0, "frac": None, "n_valid": 0, "n_mod": 0, "n_fail": 0, "n_hydroxy": 0}
    inside = [(m, h) for q, m, h in sites if window and window[0] <= q < window[1]]
    for m, h in inside:
        ignored = convention == "ignore_h"
        p = {"m": m + h / 2, "C": 1 - m - h / 2} if ignored else {"m": m, "h": h, "C": max(0.0, 1 - m - h)}
        call = max(p, key=p.get)  # m before h before C on ties
        kind = "n_fail" if p[call] < threshold else {"m": "n_mod", "h": "n_hydroxy", "C": ""}[call]
        out["n_valid"] += kind != "n_fail"
        if kind:
            out[kind] += 1
    if inside:
        out |= {"n": len(inside), "mean": sum(m for m, _ in inside) / len(inside)}
    if out["n_valid"]:
        out["frac"] = (out["n_mod"] + (out["n_hydroxy"] if convention == "combine" else 0)) / out["n_valid"]
    return out


def _observe(options: S.Options):
    names = OBSERVED.fieldNames()
    schema = to_arrow_schema(OBSERVED)

    def one(r: dict) -> dict | None:
        size = r["unit_len"]
        period = (r["period"]["left"], r["period"]["right"]) if r["period"] else (0, 0)
        a = geometry.alignment(r["pos"], r["cigar"], bool(r["flag"] & 16))
        seq = None if r["seq"] in (None, "*", "") else r["seq"]
        base = {"locus": r["id"], "ord": r["ord"], "name": r["name"], "reverse": a.reverse, "mapq": r["mapq"], "hp": r["hp"] or 0, "read_length": a.read_length}
        o = geometry.observe(a, seq, r["start_pos"], r["end_pos"], options.anchor, options.flank, options.min_clip, max(options.margin, 2 * size), period, size > 12)
        out = dict.fromkeys(names) | base
        if o is None:
            return out
        m = motifs(size, *(tuple(r[k] or ()) for k in ("ref_motifs", "pathogenic_motifs", "benign_motifs", "interruption_motifs")))
        spanning = o.kind == "spanning"
        upper = (o.segment or "").upper()
        run = m.decompose(upper, o.window if spanning else None, o.size_bp if spanning else None) if upper else None
        out |= {"read_class": o.kind, "has_segment": o.segment is not None, "size_bp": o.size_bp, "edge": o.edge}
        if run:
            shown = [upper[at : at + size] for label, at in run.units if label == "I"]
            out |= {"labels": run.labels, "run_seq": o.segment[run.start : run.end], "run_units": [at - run.start for _, at in run.units], "phase": run.phase and run.phase[0] + run.phase[1], "interruptions": shown}
            out["other_period"] = competing_period(out["run_seq"], size, r["other_periods"]) if spanning and r["other_periods"] and m.composition else None
        if not spanning:
            out["lower_bound"] = 0 if not upper else m.loose(upper) if o.window is None else m.crossed(upper, o.window, o.kind != "right_partial")
        if spanning and run is None:
            return out  # no run, so no methylation either
        sites = basemods.cytosine_sites(seq or "", a.reverse, r["mm"], r["ml"], r["mn"])
        windows = {"tract": (o.seg_left + run.start, o.seg_left + run.end) if spanning else None}
        for side in ("up", "down"):
            w = r[f"{side}_window"]
            windows[side] = a.window(w["start"], w["end"]) if w and a.pos <= w["start"] and a.ref_end >= w["end"] else None
        out |= {k: methylation(sites, w, options.meth_threshold, options.meth_convention) for k, w in windows.items()}
        if windows["tract"]:
            lo, hi = windows["tract"]
            out["per_site"] = ",".join(f"{q - lo}:{round(100 * p)}" for q, p, _ in sites if lo <= q < hi) or None
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(r) for r in batch.to_pylist()], schema=schema)

    return run


def observations(reads: DataFrame, loci: DataFrame, options: S.Options = S.Options()) -> DataFrame:
    """Every usable record at every locus it overlaps, with what it shows of the tract."""
    reach = options.flank + options.anchor
    left = R.usable(reads, options).withColumn("l_start", F.col("pos")).withColumn("l_end", _reference_end(reads))
    right = loci.select(F.col("found_contig").alias("contig"), (F.greatest(F.col("start_pos") - reach, F.lit(0))).alias("r_start"), (F.col("end_pos") + reach).alias("r_end"), *_LOCUS)
    joined = interval_join(left, right).drop("l_start", "l_end", "r_start", "r_end", "contig")
    return joined.mapInArrow(_observe(options), OBSERVED)


def _reference_end(reads: DataFrame) -> Column:
    from ..functions.sequence import reference_end

    return reference_end(F.col("pos"), F.col("cigar"))


def one_per_read(obs: DataFrame, loci: DataFrame, options: S.Options = S.Options()) -> DataFrame:
    """One observation a read name and locus, with ``units``, ``exact``, ``bound`` and its class.

    Spanning reads without a run keep their row as ``no_run``.
    """
    spanning = R.first_spanning(obs)
    part = R.partials(obs, spanning)
    pairs = R.pair_splits(part)
    carrier = part.select("locus", "ord", *[c for c in OBSERVED.fieldNames() if c not in ("locus", "ord", "name", "mapq", "hp", "read_length", "size_bp", "read_class", "edge")])
    lefts = part.select("locus", F.col("ord").alias("l_ord"), F.col("has_segment").alias("l_has"), "read_length")
    chosen = pairs.join(lefts, ["locus", "l_ord"]).withColumn("ord", F.when(F.col("l_has"), F.col("l_ord")).otherwise(F.col("r_ord"))).drop("r_ord", "l_has")
    size = F.greatest(F.lit(0), F.col("gap") - 2 * options.anchor)
    splits = chosen.join(carrier, ["locus", "ord"]).withColumns({"size_bp": size, "read_class": F.lit("split"), "edge": F.lit(None).cast("long")}).drop("gap", "l_ord")
    rest = R.best_partial(part, pairs)
    names = OBSERVED.fieldNames()
    rows = reduce(DataFrame.unionByName, [x.select(*names) for x in (spanning, splits, rest)])
    rows = rows.join(loci.select(F.col("id").alias("locus"), "unit_len"), "locus")
    span, split, has_run = F.col("read_class") == "spanning", F.col("read_class") == "split", F.col("labels").isNotNull()
    by_size = F.rint(F.col("size_bp") / F.col("unit_len"))
    n_units = F.length("labels").cast("double")
    units = F.when(span & has_run, F.when(F.col("size_bp") != 0, F.greatest(by_size, F.lit(1.0))).otherwise(n_units)).when(split & (F.col("size_bp") != 0), by_size)
    return rows.withColumns(
        {
            "units": units,
            "exact": span & has_run,
            "bound": F.when(~span, F.greatest(F.coalesce("lower_bound", F.lit(0)), F.coalesce(units, F.lit(0.0)))).cast("double"),
            "estimated": F.coalesce((span & has_run & (F.col("size_bp") != 0)) | split, F.lit(False)),
            "read_class": F.when(span & ~has_run, "no_run").otherwise(F.col("read_class")),
        }
    )


def assigned_reads(rows: DataFrame, loci: DataFrame, options: S.Options = S.Options()) -> DataFrame:
    """Reads with their allele (null for none), its method and notes.

    Spanning reads form the alleles; only where a locus has none do split reads. Else a
    split read joins the nearest allele within the tolerance.
    """
    calls = rows.where("units is not null and units != 0")
    pool = calls.groupBy("locus").agg(F.bool_or("exact").alias("any_exact"))
    calls = calls.join(pool, "locus")
    used = calls.where(F.col("exact") == F.col("any_exact"))
    ploidy = loci.select(F.col("id").alias("locus"), C.ploidy(F.col("contig"), options.sex).alias("ploidy")).where("ploidy > 0")
    cells = stats.histogram(used, ["locus", "hp"], "units").join(ploidy, "locus")
    alleles = cut(assign_alleles(cells, options), "assigned-cells")  # three readers, one run of the mixture kernel
    key = ["locus", "hp", "value"]
    direct = used.withColumn("value", F.col("units")).join(alleles.drop("n"), key).select("locus", "ord", "name", "allele", "method", "notes")
    centres = alleles.where("allele > 0").select("locus", F.col("allele").alias("idx"), F.col("median").alias("centre")).distinct()
    others = calls.where(~F.col("exact") & F.col("any_exact")).select("locus", "ord", "name", "units")
    near = stats.nearest_centre(others, centres, ["locus"], "units").where("idx is not null")
    marks = direct.unionByName(near.select("locus", "ord", "name", F.col("idx").alias("allele"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("notes")))
    per_allele = alleles.where("allele > 0").groupBy("locus", "allele").agg(F.first("median").alias("centre"), F.first("allele_hp").alias("allele_hp"), F.first("minor").alias("minor"))
    return rows.join(marks, ["locus", "ord", "name"], "left").join(per_allele, ["locus", "allele"], "left")


_SEQ_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
_SEQ = "locus string, allele int, structure string, seq string, motif string, n_exact int, int_pos string, n_interruption long, n_pathogenic long, n_benign long, noise double, other_period int"


def _sequences(rows: list[dict]) -> dict:
    """Representative, consensus and label statistics of an allele's reads with a run.

    rows: equal reads once, in order of their first, with ``weight``.
    """
    first = rows[0]
    m = motifs(first["unit_len"], *(tuple(first[k] or ()) for k in ("ref_motifs", "pathogenic_motifs", "benign_motifs", "interruption_motifs")))
    size, centre = first["unit_len"], first["centre_all"]
    weights = np.array([r["weight"] for r in rows])
    n = int(weights.sum())

    def middle(values: list) -> float:
        order = np.argsort(values, kind="stable")
        at = np.searchsorted(np.cumsum(weights[order]), [(n - 1) // 2, n // 2], side="right")
        return float(np.asarray(values)[order][at].sum()) / 2

    reads = []
    for r in rows:
        phase = r["phase"] and (r["phase"][0], r["phase"][1:])
        reads.append(cons.Read(r["run_seq"], Run(0, len(r["run_seq"]), tuple(zip(r["labels"], r["run_units"])), phase), int(r["units"]), r["weight"]))
    typical = middle([len(x.run) for x in reads])
    rep = min(range(len(reads)), key=lambda k: (abs(reads[k].units - centre), cons.shortfall(reads[k].units, len(reads[k].run)), reads[k].run.noise, abs(len(reads[k].run) - typical), k))
    shown, seq = reads[rep].run, reads[rep].seq
    source = seq.upper()
    made = cons.consensus(reads, m, rep)
    if made:
        again = m.decompose(made.upper(), (0, len(made)), len(made))
        if again and again.units and 2 * len(again) >= len(shown):
            shown, source = again, made.upper()
        seq = made
    units = Counter(source[at : at + size] for at in shown.unit_at)
    motif = max(units, key=lambda u: (units[u], m.match(u) is not None)) if units else None
    modal = [x for x in reads if x.units == round(centre)]
    spots: Counter = Counter()
    for x in modal:
        spots.update(dict.fromkeys(x.run.positions("I"), x.weight))
    common = [str(p) for p in sorted(spots) if spots[p] >= 0.5 * max(1, sum(x.weight for x in modal))]
    count = lambda label: int(middle([x.run.count(label) for x in reads]))
    hits: Counter = Counter()
    for r in rows:
        if r["other_period"]:
            hits[r["other_period"]] += r["weight"]
    other = max(hits, key=lambda p: (hits[p], -p)) if hits and 2 * hits.total() >= n else None
    return {
        "locus": first["locus"], "allele": first["allele"], "structure": shown.labels, "seq": seq, "motif": motif, "n_exact": n, "int_pos": "/".join(common) or None,
        "n_interruption": count("I"), "n_pathogenic": None if other else count("P"), "n_benign": count("B"), "noise": sum(x.run.noise * x.weight for x in reads) / n, "other_period": other,
    }


def _sequences_of(names: list[str]):
    """Rows sorted by (locus, allele, ord), ``names`` their columns."""
    fields = [x.split() for x in _SEQ.split(", ")]
    schema = pa.schema([(name, _SEQ_TYPES[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in runs_of(batches, 2):
            yield pa.RecordBatch.from_pylist([_sequences([dict(zip(names, row)) for row in g]) for g in groups], schema=schema)

    return run


def allele_table(reads: DataFrame, loci: DataFrame, options: S.Options = S.Options()) -> DataFrame:
    """One row per (locus, allele): sizes, class, structure and methylation; homozygotes twice."""
    keys = ["locus", "allele"]
    members = reads.where("allele > 0 and units is not null")
    spread = stats.spread(stats.histogram(members, keys, "units"), keys)
    fields = ["ref_motifs", "pathogenic_motifs", "benign_motifs", "interruption_motifs"]
    catalogue = loci.select(F.col("id").alias("locus"), *fields)
    exact = members.where("exact").join(spread.select(*keys, F.col("median").alias("centre_all")), keys).join(catalogue, "locus")
    content = [*keys, "units", "unit_len", "labels", "run_seq", "run_units", "phase", "other_period", "centre_all", *fields]
    counted = exact.groupBy(*content).agg(F.min("ord").alias("ord"), F.count("*").alias("weight"))
    ordered = counted.repartition(*keys).sortWithinPartitions(*keys, "ord")
    sequences = ordered.mapInArrow(_sequences_of(ordered.columns), _SEQ)
    share = lambda a, b: F.when(b > 0, a / b)
    tract, up, down = F.col("tract"), F.col("up"), F.col("down")
    valid = F.coalesce(tract["n_valid"], F.lit(0))
    meth = members.groupBy(*keys).agg(
        F.avg(tract["frac"]).alias("meth_tract"),
        share(F.sum(F.when(valid > 0, tract["n_mod"])), F.sum(valid)).alias("meth_tract_pooled"),
        F.avg(F.when(valid > 0, tract["n_hydroxy"] / valid)).alias("meth_hydroxy"),
        F.avg(F.when(tract["n"] > 0, tract["n_fail"] / tract["n"])).alias("meth_fail_frac"),
        F.avg(up["frac"]).alias("meth_up"),
        share(F.sum(F.when(up["n_valid"] > 0, up["n_mod"])), F.sum(up["n_valid"])).alias("meth_up_pooled"),
        F.avg(down["frac"]).alias("meth_down"),
        F.avg(F.when((valid >= 3) & tract["frac"].isNotNull(), (tract["frac"] >= 0.5).cast("double"))).alias("frac_meth_reads_gt50"),
        F.floor(F.expr("median(if(exact, length(run_seq), size_bp))")).cast("long").alias("allele_bp"),
        F.first("allele_hp").alias("hp"),
        F.first("minor").alias("minor"),
    )
    thresholds = [F.col(c) for c in ("bmin", "bmax", "imin", "imax", "pmin", "pmax")]
    a = spread.join(meth, keys).join(sequences, keys, "left").join(loci.select(F.col("id").alias("locus"), "contig", "bands", "composition", "interruptions_in_size", *thresholds), "locus")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    reported = C.size_units(F.col("median"), zero("n_interruption"), F.lit(options.clinical), F.col("interruptions_in_size"))
    classed = C.class_units(F.col("reported"), zero("n_benign"), zero("n_pathogenic"), F.col("composition"))
    a = a.withColumn("reported", reported).withColumn("dispersed", C.over_dispersed(F.col("median"), F.col("p95"), F.col("tail_up"), F.col("n")))
    cls = F.when(F.col("dispersed"), S.NO_CALL).when(F.col("other_period").isNotNull(), S.UNCERTAIN).otherwise(C.classify(classed, F.col("bands"), *thresholds))
    a = a.withColumn("cls", cls).withColumn("ploidy", C.ploidy(F.col("contig"), options.sex))
    return double_homozygotes(a, F.col("ploidy")).drop("bands", "composition", "interruptions_in_size", "contig", "ploidy", "bmin", "bmax", "imin", "imax", "pmin", "pmax")


_ALLELE = "reported median p5 p95 mad n allele_bp tail_up noise n_interruption int_pos n_pathogenic cls dispersed structure seq motif hp meth_tract meth_tract_pooled meth_hydroxy meth_fail_frac meth_up meth_up_pooled meth_down frac_meth_reads_gt50 other_period".split()


def locus_results(obs: DataFrame, reads: DataFrame, alleles: DataFrame, loci: DataFrame, options: S.Options = S.Options(), sample: str = "sample") -> DataFrame:
    """One row per locus of the catalogue, with structs ``a1`` and ``a2`` and ``minor`` modes."""
    main = ~F.col("minor")
    packed = F.struct(*_ALLELE)
    two = alleles.groupBy("locus").agg(
        *[F.first(F.when(main & (F.col("allele") == k), packed), ignorenulls=True).alias(f"a{k}") for k in (1, 2)],
        F.collect_list(F.when(main, F.col("reported"))).alias("medians"),
        F.coalesce(F.bool_or(main & F.col("dispersed")), F.lit(False)).alias("dispersed"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("minor"), F.struct("allele", "median", "n")))), lambda m: F.concat(F.call_function("format_number", m["median"], F.lit("0.#")), F.lit(":"), m["n"].cast("string"))), ";").alias("minor_modes"),
    )
    kind = lambda k: F.count_if(F.col("read_class") == k)
    pool = F.col("exact") | ~F.col("any_exact")
    tagged = reads.where("units is not null and units != 0").join(reads.groupBy("locus").agg(F.bool_or("exact").alias("any_exact")), "locus").where(pool)
    tagged = tagged.groupBy("locus").agg(F.avg(F.col("hp").isin(1, 2).cast("double")).alias("tagged_fraction"))
    counts = reads.groupBy("locus").agg(kind("spanning").alias("n_spanning"), kind("split").alias("n_split"), F.count_if(F.col("read_class").endswith("_partial")).alias("n_partial"), kind("no_run").alias("n_no_run"), F.max("method").alias("method"), F.max("notes").alias("assign_notes"), F.count("units").alias("n_calls"))
    bounds = stats.lower_bound(stats.histogram(reads.where("bound is not null"), ["locus"], "bound"), ["locus"])
    catalogue = loci.withColumns({"locus": F.col("id"), "ploidy": C.ploidy(F.col("contig"), options.sex)})
    needed = F.col("pmin") * F.col("unit_len") + 2 * (options.flank + options.anchor)
    lengths = obs.select("locus", "name", F.col("read_length").alias("length"), "ord").join(catalogue.select("locus", "pmin", "unit_len"), "locus")
    found = stats.detectability(lengths, ["locus"], needed)
    rows = catalogue
    for x in (two, counts, tagged, bounds, found):
        rows = rows.join(x, "locus", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    none = F.expr("cast(array() as array<double>)")
    rows = rows.withColumns({c: zero(c) for c in ("n_spanning", "n_split", "n_partial", "n_no_run", "n_reads", "support", "n_calls")})
    evidence = C.evidence_state(F.col("bound"), F.col("support"), F.coalesce("medians", none), F.col("pmin"), F.col("n_partial"))
    rows = rows.withColumns({"sample": F.lit(sample), "method": F.coalesce("method", F.lit("none")), "dispersed": F.coalesce("dispersed", F.lit(False)), "evidence": evidence, "meth_convention": F.lit(options.meth_convention)})
    reliable = C.negative_reliable(F.col("evidence"), F.col("dispersed"), F.col("n_spanning"), F.col("regime"), F.col("detectability"), options.min_support)
    return rows.withColumn("negative_reliable", reliable).withColumn("notes", notes())


def notes() -> Column:
    """What a reader of the row should know, in a fixed order."""
    number = lambda c: F.call_function("format_number", c, F.lit("0"))
    lone = F.col("a1").isNotNull() & F.col("a2").isNull() & (F.col("ploidy") == 2) & F.col("dispersed")

    def wide(k: int) -> Column:
        a = F.col(f"a{k}")
        return F.when(a["dispersed"], F.concat(F.lit(f"allele {k} is not one size: reads run from "), number(a["p5"]), F.lit(" to "), number(a["p95"])))

    def period(k: int) -> Column:
        a = F.col(f"a{k}")
        return F.when(a["other_period"].isNotNull(), F.concat(F.lit(f"allele {k} repeats every "), a["other_period"].cast("string"), F.lit(" bp: not classified")))

    few = F.col("n_no_run") > 0
    dropped = F.nullif(F.filter("unused_motifs", lambda u: u["class"].isin("reference", "pathogenic", "benign")), F.expr("cast(array() as array<struct<class:string,motif:string,reason:string>>)"))
    return F.concat_ws(
        "; ",
        F.when(F.col("found_contig").isNull(), F.concat(F.lit("contig "), F.col("contig"), F.lit(" not in the alignment"))).when(F.col("ploidy") == 0, "locus skipped for this sex").when(F.col("n_calls") == 0, "no spanning or split reads"),
        F.nullif(F.col("assign_notes"), F.lit("")),
        F.when(lone, "second allele not called"),
        F.when(few & (F.col("n_calls") == 0), F.concat(F.lit("warning: no run of the motif in "), F.col("n_no_run").cast("string"), F.lit(" spanning reads"))).when(few & (F.col("n_no_run") >= F.col("n_calls")), F.concat(F.lit("warning: as many spanning reads without a run as calls: "), F.col("n_no_run").cast("string"))),
        wide(1),
        wide(2),
        period(1),
        period(2),
        F.when(~F.col("in_reference"), F.concat(F.lit("contig "), F.col("contig"), F.lit(" not in the reference"))),
        F.array_join(F.transform(dropped, lambda u: F.concat(u["class"], F.lit(" motif "), u["motif"], F.lit(" not matched: "), u["reason"])), "; "),
    )


def call(reads: DataFrame, loci: DataFrame, options: S.Options = S.Options(), sample: str = "sample", contigs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The flagship dataflow: ``observations``, ``reads``, ``alleles`` and ``loci`` tables.

    reads: as ``schema.READS``. loci: as ``sources.catalog.load`` gives; with
    ``complete`` columns added where they are absent. contigs: the alignment's, by which
    loci are renamed and those without one are noted. Each stage is read by several
    others, so it is written once to the shared folder instead of being planned again.
    """
    loci = complete(loci)
    loci = resolve_contigs(loci, contigs) if contigs is not None else loci.withColumn("found_contig", F.col("contig"))
    obs = cut(observations(reads, loci, options), "observations")
    rows = cut(one_per_read(obs, loci, options), "reads")
    rows = cut(assigned_reads(rows, loci, options), "assigned")
    alleles = cut(allele_table(rows, loci, options), "alleles")
    return {"observations": obs, "reads": rows, "alleles": alleles, "loci": locus_results(obs, rows, alleles, loci, options, sample)}


def complete(loci: DataFrame) -> DataFrame:
    """Add the optional columns that a catalogue lacks, as missing."""
    window = "struct<start:bigint,end:bigint>"
    wanted = {
        "up_window": F.lit(None).cast(window),
        "down_window": F.lit(None).cast(window),
        "period": F.lit(None).cast("struct<left:int,right:int>"),
        "other_periods": F.expr("cast(array() as array<int>)"),
        "interruptions_in_size": F.lit(True),
        "unused_motifs": F.expr("cast(array() as array<struct<class:string,motif:string,reason:string>>)"),
        "bands": F.expr("cast(array() as array<struct<upper:double,label:string>>)"),
        "composition": F.lit(False),
        "in_reference": F.lit(True),
    }
    return loci.withColumns({k: v for k, v in wanted.items() if k not in loci.columns})
