"""Quality checks over the per-locus table: six small aggregate queries, and the worklist tier.

The table is text as written: missing is a dot or nothing, numbers are parsed leniently.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Cut-points of the checks and the locus of the promoter check.
MAX_FAIL, MIN_TAGGED, MARGIN, UNMETHYLATED, PROMOTER_LOCUS, SHOWN = 0.50, 0.50, 1.0, 0.20, "FXS_FMR1", 20


def _n(c: str) -> Column:
    return X.number(F.col(c))


def _finding(df: DataFrame, check: str, status: Column, basis: Column | str, message: Column, detail: Column | None = None) -> DataFrame:
    basis = F.lit(basis) if isinstance(basis, str) else basis
    empty = F.expr("cast(array() as array<string>)")
    return df.select(F.lit(check).alias("check"), status.alias("status"), basis.alias("basis"), message.alias("message"), (empty if detail is None else F.coalesce(detail, empty)).alias("detail"))


def _with_shown(counts: DataFrame, items: DataFrame) -> DataFrame:
    """The row of ``counts`` with ``items``: the first ``SHOWN`` of the table's rows (ord,
    text), and a mark where there are more. Only one row more than is shown is gathered."""
    top = items.orderBy("ord").limit(SHOWN + 1).agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("_top"))
    texts = F.transform(F.slice("_top", 1, SHOWN), lambda x: x["text"])
    more = F.when(F.size("_top") > SHOWN, F.array(F.lit("..."))).otherwise(F.expr("cast(array() as array<string>)"))
    one = F.lit(1).alias("_one")  # a row on each side
    return counts.select("*", one).join(top.select(F.concat(texts, more).alias("items"), one), "_one").drop("_one")


def modifications_present(rows: DataFrame) -> DataFrame:
    has = _n("a1_meth_tract").isNotNull() | _n("a1_meth_up").isNotNull()
    g = rows.agg(F.count_if(has).alias("n"), F.count("*").alias("loci"))
    status = F.when(F.col("loci") == 0, "skip").when(F.col("n") == 0, "fail").otherwise("pass")
    message = F.when(F.col("loci") == 0, "no loci").otherwise(F.format_string("methylation at %d of %d loci", "n", "loci"))
    return _finding(g, "modifications_present", status, "mechanical", message)


def modcall_confidence(rows: DataFrame) -> DataFrame:
    v = rows.select(F.explode(F.array(_n("a1_meth_fail_frac"), _n("a2_meth_fail_frac"))).alias("v")).where("v is not null")
    g = v.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("worst"))
    status = F.when(F.col("n") == 0, "skip").when(F.col("mean") > MAX_FAIL, "warn").otherwise("pass")
    message = F.when(F.col("n") == 0, "no modification calls").otherwise(F.concat(F.lit("discarded calls: mean "), X.percent1(F.col("mean")), F.lit(" %, worst "), X.percent1(F.col("worst")), F.lit(" %")))
    return _finding(g, "modcall_confidence", status, "heuristic", message)


def x_inactivation(rows: DataFrame) -> DataFrame:
    first = rows.where(F.col("locus") == PROMOTER_LOCUS).agg(F.min_by(F.struct(_n("a1_meth_up").alias("m1"), _n("a2_meth_up").alias("m2"), X.count(F.col("ploidy")).alias("ploidy"), F.lower("a1_cls").alias("cls")), "ord").alias("r")).select("r", "r.*")
    ploidy = F.when(F.coalesce("ploidy", F.lit(0)) == 0, 2).otherwise(F.col("ploidy"))
    single = ploidy == 1
    status = (
        F.when(F.col("r").isNull() | F.col("m1").isNull(), "skip")
        .when(single & F.contains("cls", F.lit("path")), "skip")
        .when(single & (F.col("m1") > UNMETHYLATED), "warn")
        .when(single, "pass")
        .when(F.col("m2").isNull(), "skip")
        .when(F.col("m1") == F.col("m2"), "warn")
        .otherwise("pass")
    )
    basis = F.when(~single & (F.col("m1") == F.col("m2")), "consistency").otherwise("biology")
    message = (
        F.when(F.col("r").isNull(), f"{PROMOTER_LOCUS} not called")
        .when(F.col("m1").isNull(), "no promoter methylation")
        .when(single & F.contains("cls", F.lit("path")), "one X, expanded: no control")
        .when(single, F.concat(F.lit("one X, promoter "), X.percent1(F.col("m1")), F.lit(" %")))
        .when(F.col("m2").isNull(), "two X, one allele measured")
        .otherwise(F.concat(F.lit("two X, promoter "), X.percent1(F.col("m1")), F.lit(" % and "), X.percent1(F.col("m2")), F.lit(" %, apart by "), X.percent1(F.abs(F.col("m1") - F.col("m2")))))
    )
    return _finding(first, "x_inactivation", status, F.coalesce(basis, F.lit("biology")), message)


def per_allele_attribution(rows: DataFrame) -> DataFrame:
    g = rows.agg(F.avg(_n("tagged_fraction")).alias("mean"), F.count_if(F.col("method").startswith("GMM")).alias("gmm"), F.count("*").alias("loci"))
    all_gmm = (F.col("mean") >= MIN_TAGGED) & (F.col("gmm") == F.col("loci"))
    status = F.when(F.col("mean").isNull(), "skip").when(all_gmm | (F.col("mean") < MIN_TAGGED), "warn").otherwise("pass")
    basis = F.when(F.col("mean") < MIN_TAGGED, "heuristic").otherwise("consistency")
    message = F.when(F.col("mean").isNull(), "no tagged fraction").otherwise(F.concat(F.lit("tagged "), X.percent1(F.col("mean")), F.format_string(" %%, %d of %d loci without tags", "gmm", "loci")))
    return _finding(g, "per_allele_attribution", status, F.coalesce(basis, F.lit("consistency")), message)


def zygosity_margin(rows: DataFrame) -> DataFrame:
    ploidy = F.coalesce(F.nullif(X.count(F.col("ploidy")), F.lit(0)), F.lit(2))
    a1, a2, p5, p95 = (_n(c) for c in ("a1_median", "a2_median", "a1_p5", "a1_p95"))
    apart = F.abs(a2 - a1)
    near = (a1 != a2) & (apart <= MARGIN)
    wide = (a1 == a2) & (p95 - p5 > 2 * MARGIN)
    pair = F.concat(F.col("locus"), F.lit(": "), X.general(a1), F.lit("/"), X.general(a2))
    text = F.when(near, F.concat(pair, F.lit(", apart by "), X.general(apart), F.lit(", "), F.coalesce("a1_cls", F.lit("")), F.lit(" and "), F.coalesce("a2_cls", F.lit("")))).otherwise(F.concat(pair, F.lit(", reads span "), X.general(p5), F.lit("-"), X.general(p95)))
    marked = rows.select("ord", (ploidy >= 2).alias("ok"), near.alias("near"), wide.alias("wide"), (~F.col("a1_cls").eqNullSafe(F.col("a2_cls"))).alias("differ"), text.alias("text"))
    serious = F.col("ok") & F.coalesce((F.col("near") & F.col("differ")) | F.col("wide"), F.lit(False))
    close = F.col("ok") & F.coalesce(F.col("near") & ~F.col("differ"), F.lit(False))
    g = marked.agg(F.count_if(serious).alias("n"), F.count_if(close).alias("close"), F.count("*").alias("loci"))
    g = _with_shown(g, marked.where(serious).select("ord", "text"))
    status = F.when(F.col("loci") == 0, "skip").when(F.col("n") > 0, "warn").otherwise("pass")
    message = F.when(F.col("loci") == 0, "no loci").otherwise(F.format_string("%d calls may change, %d close in one class", "n", "close"))
    return _finding(g, "zygosity_margin", status, "heuristic", message, F.col("items"))


def negative_evidence(rows: DataFrame) -> DataFrame:
    said = rows.where(F.col("negative_reliable").isNotNull() & ~F.col("negative_reliable").isin("", X.MISSING))
    bad = X.count(F.col("negative_reliable")) == 0
    g = said.agg(F.count_if(bad).alias("n"), F.count("*").alias("loci"))
    g = _with_shown(g, said.where(bad).select("ord", F.col("locus").alias("text")))
    status = F.when(F.col("loci") == 0, "skip").when(F.col("n") > 0, "warn").otherwise("pass")
    message = F.when(F.col("loci") == 0, "no negative_reliable").otherwise(F.format_string("%d of %d loci support a negative", F.col("loci") - F.col("n"), "loci"))
    return _finding(g, "negative_evidence", status, "consistency", message, F.col("items"))


CHECKS = (modifications_present, modcall_confidence, x_inactivation, per_allele_attribution, zygosity_margin, negative_evidence)


def run_checks(rows: DataFrame) -> DataFrame:
    """All findings, in order of the checks."""
    numbered = [check(rows).withColumn("no", F.lit(k)) for k, check in enumerate(CHECKS)]
    return reduce(DataFrame.unionByName, numbered)


def tier() -> Column:
    """Worklist tier of a row: finding, check, uninformative or normal.

    A class is a finding where it contains ``path`` or is missing; other labels are not.
    """
    classes = F.array(F.coalesce("a1_cls", F.lit("")), F.coalesce("a2_cls", F.lit("")))
    some = lambda test: F.exists(classes, test)
    a1, a2 = _n("a1_median"), _n("a2_median")
    close = (a1 != a2) & (F.abs(a2 - a1) <= MARGIN) & (classes[0] != classes[1])
    finding = some(lambda c: F.contains(c, F.lit("path")) | (c == "no_call")) | (F.col("evidence") == "EXPANSION_LB") | (_n("a1_dispersed") != 0) | (_n("a2_dispersed") != 0)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(finding), "finding").when(some(lambda c: c.isin("intermediate", "uncertain")) | yes(close), "check").when(yes(_n("negative_reliable") == 0), "uninformative").otherwise("normal")


def exit_code(findings: list, strict: bool = False) -> int:
    states = {f["status"] for f in findings}
    return 2 if "fail" in states else 1 if strict and "warn" in states else 0
