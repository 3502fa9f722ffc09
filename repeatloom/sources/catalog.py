"""Locus catalogue: JSON records and a YAML overlay as DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import classify as C
from ..functions import sequence as Q
from ..functions import text as X

_LISTS = "reference_motif_reference_orientation pathogenic_motif_reference_orientation benign_motif_reference_orientation unknown_motif_reference_orientation interruption_reference_orientation inheritance".split()
_NUMBERS = "benign_min benign_max intermediate_min intermediate_max pathogenic_min pathogenic_max ref_copies".split()
_TEXTS = "id gene disease chrom gene_strand mechanism".split()


def record_schema() -> T.StructType:
    """The keys that are read, pinned: empty arrays and all-null columns infer as text."""
    ints = [f"{k}_{b}" for b in S.BUILDS for k in ("start", "stop")] + ["motif_len"]
    fields = [T.StructField(k, T.StringType()) for k in _TEXTS]
    fields += [T.StructField(k, T.DoubleType()) for k in (*_NUMBERS, *ints)]
    return T.StructType(fields + [T.StructField(k, T.ArrayType(T.StringType())) for k in _LISTS])


def of_length(motifs: Column, n: Column) -> Column:
    upper = F.transform(F.coalesce(motifs, F.expr("cast(array() as array<string>)")), lambda m: F.upper(F.trim(m)))
    return F.filter(upper, lambda m: F.length(m) == n)


def load(spark: SparkSession, path: str, build: str = "hg38", overlay: dict | None = None) -> DataFrame:
    """Loci of a JSON array of records, a row each in file order (``ord``)."""
    return from_records(read_records(spark, path), build, overlay)


def dropped(raw: DataFrame, build: str = "hg38") -> DataFrame:
    """(id, ord) of records that ``from_records`` leaves out."""
    n = F.col("motif_len").cast("int")
    usable = F.lit(False)
    for kind in ("reference", "pathogenic"):
        usable = usable | (F.size(of_length(F.col(f"{kind}_motif_reference_orientation"), n)) > 0)
    return raw.where(F.col(f"start_{build}").isNull() | F.col(f"stop_{build}").isNull() | ~F.coalesce(usable, F.lit(False))).select("id", "ord")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array, a row each in file order (``ord``)."""
    raw = spark.read.schema(record_schema()).option("multiLine", True).json(path)
    return raw.withColumn("ord", F.monotonically_increasing_id())


def from_records(raw: DataFrame, build: str = "hg38", overlay: dict | None = None) -> DataFrame:
    """Loci of records as ``record_schema`` has them, with ``ord``.

    Records without an interval in the build, or without a motif of the unit's length,
    are dropped; of records with one id the last counts. overlay: as ``read_overlay`` gives.
    """
    if build not in S.BUILDS:
        raise ValueError(f"unknown build {build}: one of {', '.join(S.BUILDS)}")
    last = Window.partitionBy("id").orderBy(F.desc("ord"))
    raw = raw.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    n = F.col("motif_len").cast("int")
    same = {k.split("_")[0]: of_length(F.col(k), n) for k in _LISTS[:5]}
    reference = F.when(F.size(same["reference"]) > 0, same["reference"]).otherwise(same["pathogenic"])
    rows = raw.select(
        "ord",
        *_TEXTS,
        n.alias("unit_len"),
        F.col(f"start_{build}").cast("long").alias("start_pos"),
        F.col(f"stop_{build}").cast("long").alias("end_pos"),
        F.col("chrom").alias("contig"),
        reference.alias("ref_motifs"),
        *[same[k].alias(f"{k}_motifs") for k in ("pathogenic", "benign", "unknown", "interruption")],
        *[F.col(k).alias(f"{k.split('_')[0]}_all") for k in _LISTS[:5]],
        F.col("benign_min").alias("bmin"),
        F.col("benign_max").alias("bmax"),
        F.col("intermediate_min").alias("imin"),
        F.col("intermediate_max").alias("imax"),
        F.col("pathogenic_min").alias("pmin"),
        F.col("pathogenic_max").alias("pmax"),
        "ref_copies",
        "inheritance",
        C.regime(F.col("pathogenic_max"), n).alias("regime"),
        F.expr("cast(array() as array<struct<upper:double,label:string>>)").alias("bands"),
        F.expr("cast(array() as array<string>)").alias("aliases"),
    ).where("start_pos is not null and end_pos is not null and size(ref_motifs) > 0")
    if overlay:
        rows = with_overlay(rows, overlay)
    return derived(rows)


_UNUSED = "array<struct<class:string,motif:string,reason:string>>"


def _unmatched(kind: str, n: Column) -> Column:
    """Motifs of a class whose length is not the unit's."""
    none = F.expr("cast(array() as array<string>)")
    other = F.filter(F.transform(F.coalesce(F.col(f"{kind}_all"), none), F.upper), lambda m: F.length(m) != n)
    why = lambda m: F.format_string("%d bp against a unit of %d", F.length(m), n)
    return F.transform(other, lambda m: F.struct(F.lit(kind).alias("class"), m.alias("motif"), why(m).alias("reason")))


def derived(rows: DataFrame) -> DataFrame:
    """Columns that follow from a record and its overlay: composition, motif on the gene's
    strand, unused motifs, other periods, methylation windows."""
    n = F.col("unit_len")
    have = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    unused = F.concat(*[_unmatched(k, n) for k in ("reference", "pathogenic", "benign", "unknown")])
    overruled = F.transform(have("unused_interruptions", "array<string>"), lambda m: F.struct(F.lit("interruption").alias("class"), m.alias("motif"), F.lit("other interruptions are used").alias("reason")))
    unused = F.concat(unused, F.coalesce(overruled, _unmatched("interruption", n))).cast(_UNUSED)
    other = F.filter(F.transform(F.filter(F.col("unused_motifs"), lambda u: u["class"] != "interruption"), lambda u: F.length(u["motif"])), lambda p: (p % n != 0) & (n % p != 0))
    up, down = (F.coalesce(have(c, "int"), F.lit(0)) for c in ("meth_up_bp", "meth_down_bp"))
    before = lambda bp: F.struct((F.col("start_pos") - bp).alias("start"), F.col("start_pos").alias("end"))
    after = lambda bp: F.struct(F.col("end_pos").alias("start"), (F.col("end_pos") + bp).alias("end"))
    plus = F.col("gene_strand") == "+"
    cpg = F.exists("ref_motifs", lambda m: F.contains(F.concat(m, m), F.lit("CG")))
    distinct_from = F.array_except("pathogenic_motifs", F.flatten(F.transform("ref_motifs", Q.rotations)))
    made = rows.withColumns(
        {
            "unused_motifs": unused,
            "composition": F.size(distinct_from) > 0,
            "gene_motif": Q.on_strand(F.col("ref_motifs")[0], F.col("gene_strand")),
            "interruptions_in_size": F.coalesce(have("interruptions_in_size", "boolean"), F.lit(True)),
            "meth_relevant": F.coalesce(have("meth_relevant", "boolean"), cpg),
            "up_window": F.when(up > 0, F.when(plus, before(up)).otherwise(after(up))),
            "down_window": F.when(down > 0, F.when(plus, after(down)).otherwise(before(down))),
        }
    )
    return made.withColumn("other_periods", F.sort_array(F.array_distinct(other)).cast("array<int>"))


def dropped_motifs(loci: DataFrame) -> DataFrame:
    """(id, class, motif, reason): motifs that results would be classed by, but that are not matched."""
    return loci.select("id", F.explode("unused_motifs").alias("u")).select("id", "u.*").where(F.col("class").isin("reference", "pathogenic", "benign"))


def read_overlay(path: str) -> dict:
    """A YAML overlay: ``loci`` (aliases, bands, interruptions, caveats by id), ``inhouse``
    (bands by id, which replace the others), ``sources``, ``discrepancies``."""
    import yaml

    found = yaml.safe_load(Path(path).read_text()) or {}
    for k, entry in (found.get("inhouse") or {}).items():
        own = found.setdefault("loci", {}).setdefault(k, {})
        own |= {"bands": entry.get("bands", []), "inhouse": True}
    return found


def overlay_frame(spark: SparkSession, overlay: dict) -> DataFrame:
    """One row per locus of the overlay: aliases, bands, interruptions, methylation, caveats."""
    rows = []
    for k, e in (overlay.get("loci") or {}).items():
        bands = [(None if b.get("upper") is None else float(b["upper"]), str(b["label"])) for b in e.get("bands") or []]
        meth = e.get("methylation") or {}
        counted = e.get("interruptions_in_size")
        rows.append((k, [str(a) for a in e.get("aliases") or []], bands, [str(m) for m in e.get("interruptions_gene") or []], None if counted is None else bool(counted), bool(meth.get("relevant", False)), int(meth.get("up_bp") or 0), int(meth.get("down_bp") or 0), [str(c) for c in e.get("caveats") or []], bool(e.get("inhouse", False))))
    schema = "id string, o_aliases array<string>, o_bands array<struct<upper:double,label:string>>, o_interruptions array<string>, o_counted boolean, o_meth boolean, o_up int, o_down int, o_caveats array<string>, o_inhouse boolean"
    return spark.createDataFrame(rows, schema)


def with_overlay(rows: DataFrame, overlay: dict) -> DataFrame:
    """Bands, aliases, methylation windows and interruptions of the overlay; its
    interruptions, on the gene's strand, replace the catalogue's even where it lists none."""
    joined = rows.join(F.broadcast(overlay_frame(rows.sparkSession, overlay)), "id", "left")
    known = F.col("o_inhouse").isNotNull()
    turned = F.transform("o_interruptions", lambda m: Q.on_strand(m, F.col("gene_strand")))
    none = F.expr("cast(array() as array<string>)")
    listed = F.transform(F.coalesce("interruption_all", none), F.upper) if "interruption_all" in rows.columns else F.col("interruption_motifs")
    made = joined.withColumns(
        {
            "aliases": F.coalesce("o_aliases", "aliases"),
            "bands": F.coalesce("o_bands", "bands"),
            "unused_interruptions": F.when(known, F.filter(listed, lambda m: ~F.array_contains(turned, m))),
            "interruption_motifs": F.when(known, turned).otherwise(F.col("interruption_motifs")),
            "interruptions_in_size": F.coalesce("o_counted", F.lit(True)),
            "meth_relevant": F.when(known, F.col("o_meth")),
            "meth_up_bp": F.coalesce("o_up", F.lit(0)),
            "meth_down_bp": F.coalesce("o_down", F.lit(0)),
            "caveats": F.coalesce("o_caveats", none),
            "inhouse": F.coalesce("o_inhouse", F.lit(False)),
        }
    )
    return made.drop(*[c for c in made.columns if c.startswith("o_")])


def lookup(loci: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Loci whose id, gene or alias equals a key, whatever the case, with the ``key``."""
    wanted = loci.sparkSession.createDataFrame([(k, k.upper()) for k in dict.fromkeys(keys)], "key string, _key string")
    names = [F.upper(c) for c in columns or ["id", "gene"]]
    more = F.transform("aliases", F.upper) if columns is None else F.expr("cast(array() as array<string>)")
    spread = loci.withColumn("_key", F.explode(F.array_distinct(F.concat(F.array(*names), more))))
    return spread.join(F.broadcast(wanted), "_key").drop("_key")


def unknown_keys(loci: DataFrame, keys: list[str]) -> list[str]:
    """Keys that name no locus (bounded by the keys given)."""
    found = {r["key"] for r in lookup(loci, keys).select("key").distinct().collect()}
    return [k for k in keys if k not in found]


def bed(loci: DataFrame, flank: int = 0) -> DataFrame:
    """contig, start, end, motif, name, ord: padded intervals, starts not below 0."""
    return loci.select("contig", F.greatest(F.col("start_pos") - flank, F.lit(0)).alias("start"), (F.col("end_pos") + flank).alias("end"), F.element_at("ref_motifs", 1).alias("motif"), F.col("id").alias("name"), "ord")


def listing(loci: DataFrame) -> DataFrame:
    """The catalogue as text columns, with ``ord``."""
    shown = lambda c: F.when(F.col(c).isNull(), X.MISSING).when(F.col(c) == F.rint(c), F.col(c).cast("long").cast("string")).otherwise(X.general(F.col(c)))
    bp = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0")) if c in loci.columns else F.lit("0")
    between = F.when(F.col("imin").isNull(), X.MISSING).otherwise(F.concat_ws("-", shown("imin"), shown("imax")))
    columns = {
        "id": F.col("id"), "gene": F.col("gene"), "chrom": F.col("contig"), "start": F.col("start_pos").cast("string"), "end": F.col("end_pos").cast("string"), "strand": F.col("gene_strand"), "motif_gene": F.col("gene_motif"),
        "motif_ref": F.element_at("ref_motifs", 1), "unit_len": F.col("unit_len").cast("string"), "regime": F.col("regime"), "composition": X.flag(F.col("composition")), "benign_max": shown("bmax"), "intermediate": between,
        "pathogenic_min": shown("pmin"), "pathogenic_max": shown("pmax"), "meth_relevant": X.flag(F.col("meth_relevant")), "meth_up_bp": bp("meth_up_bp"), "meth_down_bp": bp("meth_down_bp"), "aliases": F.array_join("aliases", ","),
    }
    return loci.select(*[v.alias(k) for k, v in columns.items()], "ord")


def short_motif(motif: Column) -> Column:
    """A motif as it is told to a reader: long ones by their first bases and length."""
    return F.when(F.length(motif) <= 12, motif).otherwise(F.concat(F.substring(motif, 1, 9), F.format_string("...(%d bp)", F.length(motif))))


def told_motifs(loci: DataFrame) -> DataFrame:
    """(id, class, motif, reason, ord): every motif that is not matched, shortened."""
    return loci.select("id", "ord", F.explode("unused_motifs").alias("u")).select("id", "u.class", short_motif(F.col("u.motif")).alias("motif"), "u.reason", "ord")


def provenance(spark: SparkSession, overlay: dict) -> DataFrame:
    """Every claim of the overlay with its source: (kind, locus, no, upper, label, claim,
    source, section, quote, note, inhouse, jurisdiction, citation, open_access).

    kind is ``band`` (two claims each: its boundary and its naming) or ``discrepancy``.
    A claim without a source, or whose source is not listed, has no citation.
    """
    text = lambda d, k: None if d.get(k) in (None, "") else " ".join(str(d[k]).split())
    claims = []
    for locus, entry in (overlay.get("loci") or {}).items():
        for no, band in enumerate(entry.get("bands") or []):
            upper = None if band.get("upper") is None else float(band["upper"])
            for claim in ("boundary", "naming"):
                said = band.get(claim) or {}
                note = text(band, "rationale") if entry.get("inhouse") else text(said, "note")
                claims.append(("band", locus, no, upper, str(band.get("label")), claim, text(said, "source"), text(said, "section"), text(said, "quote"), note, bool(entry.get("inhouse"))))
    for no, d in enumerate(overlay.get("discrepancies") or []):
        label = f"{d.get('catalogue')} against {d.get('other')}"
        claims.append(("discrepancy", str(d.get("locus")), no, None, label, text(d, "field"), text(d, "other_source"), text(d, "kind"), text(d, "applied"), text(d, "note"), False))
    sources = [(k, text(s, "jurisdiction"), text(s, "citation"), bool(s.get("open_access"))) for k, s in (overlay.get("sources") or {}).items()]
    left = spark.createDataFrame(claims, "kind string, locus string, no int, upper double, label string, claim string, source string, section string, quote string, note string, inhouse boolean")
    right = spark.createDataFrame(sources, "source string, jurisdiction string, citation string, open_access boolean")
    return left.join(right, "source", "left")


def resolve_contigs(loci: DataFrame, contigs: DataFrame) -> DataFrame:
    """Loci with ``found_contig``: their contig in the alignment's naming - as it is, with or
    without chr, or the mitochondrion's other name - or null where the header has none.

    contigs: ``contig``, a row for each in the header (a few thousand at most).
    """
    c = F.col("contig")
    other = F.when(c.startswith("chr"), F.expr("substr(contig, 4)")).otherwise(F.concat(F.lit("chr"), c))
    mito = F.when(c == "chrM", "MT").when(c == "MT", "chrM")
    for k, name in enumerate((c, other, mito)):
        known = F.broadcast(contigs.select(F.col("contig").alias(f"_c{k}")).distinct())
        loci = loci.join(known, name == F.col(f"_c{k}"), "left")
    return loci.withColumn("found_contig", F.coalesce("_c0", "_c1", "_c2")).drop("_c0", "_c1", "_c2")
