"""Every query with SQL against DuckDB on the smallest tables, and properties of operators."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from repeatloom import schema as S
from repeatloom.functions import classify as C
from repeatloom.functions import sequence as Q
from repeatloom.functions import text as X
from repeatloom.operators import intervals, stats
from repeatloom.plans import qc, registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    assert got or name in ("split_pairing", "alias_lookup", "find_regions")
    if name in registry.ORACLE_SQL:
        rel = duck.sql(registry.ORACLE_SQL[name])
        at = sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
        assert [rel.columns[k] for k in at] == columns
        kinds = [str(rel.types[k]) for k in at]
        assert kinds == [TYPES.get(df.schema[c].dataType.simpleString(), k) for c, k in zip(columns, kinds)]
        assert got == sorted(repr([plain(r[k]) for k in at]) for r in rel.fetchall())


def test_loci_without_two_tagged_haplotypes_get_two_alleles(spark, tmp_path):
    read = lambda locus, units, flag: (locus, float(units), flag, "F", 0.0, 0.0)
    rows = [read(1, u, "A") for u in (10, 10, 11, 10, 40, 41, 40, 40)] + [read(2, u, f) for u, f in ((10, "A"), (10, "A"), (10, "A"), (30, "R"), (30, "R"), (30, "R"))]
    spark.createDataFrame(rows, "l_partkey long, l_quantity double, l_returnflag string, l_linestatus string, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "b", 7) for k in (1, 2)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {x.locus: (x.method, x.a1_median, x.a2_median, x.a1_support, x.a2_support) for x in registry.QUERIES["loci_table"](spark, str(tmp_path)).collect()}
    assert got == {"L1": ("GMM", "10.0", "40.0", "4", "4"), "L2": ("HP", "10.0", "30.0", "3", "3")}


def test_interval_joins_agree(spark):
    r = random.Random(1)
    make = lambda n: [(r.choice("ab"), s, s + r.randint(0, 300)) for s in (r.randint(0, 5000) for _ in range(n))]
    a, b = make(150), make(120)
    left = spark.createDataFrame([(*x, k) for k, x in enumerate(a)], "contig string, l_start long, l_end long, i int")
    right = spark.createDataFrame([(*x, k) for k, x in enumerate(b)], "contig string, r_start long, r_end long, j int")
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    for width in (7, 64, 10_000):
        assert sorted((x.i, x.j) for x in intervals.interval_join(left, right, width).collect()) == want


def test_merge_is_transitive_and_touching_counts(spark):
    rows = [("a", 0, 100, "w", 0), ("a", 10, 20, "x", 1), ("a", 90, 120, "y", 2), ("a", 120, 130, "z", 3), ("a", 131, 140, "q", 4), ("b", 5, 6, "r", 5)]
    df = spark.createDataFrame(rows, "contig string, start long, end long, name string, ord int")
    for width in (15, 64, 1 << 20):
        got = intervals.merge_intervals(df, width=width).orderBy("contig", "start").collect()
        assert [(x.contig, x.start, x.end, x.names) for x in got] == [("a", 0, 130, "w,x,y,z"), ("a", 131, 140, "q"), ("b", 5, 6, "r")]


CASES = [
    ((None, 5, 44, 45, 200, 201, 2000), "no_call"), ((20, 5, 44, 45, 200, 201, 2000), "benign"), ((3, 5, 44, 45, 200, 201, 2000), "benign"), ((60, 5, 44, 45, 200, 201, 2000), "intermediate"), ((500, 5, 44, 45, 200, 201, 2000), "pathogenic"),
    ((44.5, 5, 44, 45, 200, 201, 2000), "uncertain"), ((2, 5, 44, None, None, 1, 3), "pathogenic"), ((4, 5, 44, None, None, 1, 3), "uncertain"), ((9, None, None, None, None, None, None), "uncertain"), ((9, None, None, None, None, 5, None), "pathogenic"),
]


def test_classes(spark):
    rows = [tuple(None if v is None else float(v) for v in c) for c, _ in CASES]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{c} double" for c in "u bmin bmax imin imax pmin pmax".split()))
    found = df.select("k", C.classify_thresholds(*[F.col(c) for c in df.columns[1:]]).alias("c")).orderBy("k").collect()
    assert [x.c for x in found] == [want for _, want in CASES]


def test_evidence_dispersion_and_negatives(spark):
    one = spark.range(1)
    lit = F.lit
    state = lambda b, s, m, p, n: one.select(C.evidence_state(lit(b).cast("double"), lit(s), F.array(*map(lit, m)).cast("array<double>"), lit(p).cast("double"), lit(n))).first()[0]
    assert state(100, 2, [30.0], 200, 3) == "EXPANSION_LB" and state(40, 2, [30.0], 200, 3) == "PARTIALS_PRESENT" and state(100, 1, [30.0], None, 1) == "NONE" and state(100, 2, [95.0], 50, 0) == "NONE" and state(None, 0, [], None, 2) == "PARTIALS_PRESENT"
    wide = lambda m, p, t, n: one.select(C.over_dispersed(*[lit(x).cast("double") for x in (m, p, t)], lit(n))).first()[0]
    assert wide(10, 16, 0.2, 10) and not wide(10, 15, 0.2, 10) and not wide(10, 16, 0.14, 10) and not wide(None, 1, 1, 1)
    negative = lambda e, d, n, r, x: one.select(C.negative_reliable(lit(e), lit(d), lit(n), lit(r), lit(x).cast("double"), 3)).first()[0]
    assert negative("NONE", False, 3, "short", None) and not negative("NONE", False, 2, "short", 1) and not negative("NONE", False, 3, "expansion", None) and negative("NONE", False, 3, "expansion", 0.8) and not negative("EXPANSION_LB", False, 9, "short", 1)
    call = lambda m, h, c="modkit": one.select(C.modification_call(lit(m), lit(h), 0.8, c)).first()[0]
    assert [call(0.9, 0.0), call(0.0, 0.9), call(0.05, 0.05), call(0.5, 0.3), call(0.7, 0.25, "ignore_h"), call(0.7, 0.25)] == ["m", "h", "C", "fail", "m", "fail"]
    assert one.select(C.ploidy(lit("chrX"), "XY"), C.ploidy(lit("Y"), "XX"), C.ploidy(lit("chr1"), "XY")).first()[:] == (1, 0, 2)


def test_sequence_and_text_functions(spark):
    one = spark.range(1)
    lit = F.lit
    r = one.select(Q.revcomp(lit("AACgN")), Q.rotations(lit("CAG")), Q.lag_matches(lit("CAGCAGCAT"), lit(3)), F.to_json(Q.run_lengths(lit("CCoP"))), F.to_json(Q.run_lengths(lit("")))).first()
    assert r[0] == "NCGTT" and r[1] == ["CAG", "AGC", "GCA"] and r[2] == 5 and r[3] == '[{"label":"C","n":2},{"label":"o","n":1},{"label":"P","n":1}]' and r[4] == "[]"
    r = one.select(X.fixed(lit(0.125), 2), X.fixed(lit(None).cast("double"), 1), X.whole(lit(3.0)), X.flag(lit(True)), X.number(lit("1_0.5")), X.number(lit(".")), X.number(lit("x")), X.general(lit(2.50)), X.general(lit(30.0)), X.text(lit(""))).first()
    assert r[:] == ("0.12", ".", "3", "1", 10.5, None, None, "2.5", "30", ".")


def test_histogram_statistics_equal_plain_ones(spark):
    r = random.Random(2)
    values = [(k % 3, float(r.randint(1, 40))) for k in range(300)]
    s = {x.k: x for x in stats.spread(stats.histogram(spark.createDataFrame(values + [(9, None)], "k int, v double"), ["k"], "v"), ["k"]).collect()}
    import numpy as np

    assert set(s) == {0, 1, 2}
    for k, row in s.items():
        v = np.array([x for g, x in values if g == k])
        m = np.median(v)
        assert (row.n, row.median) == (len(v), m) and row.mad == np.median(abs(v - m)) and abs(row.p5 - np.quantile(v, 0.05)) < 1e-9 and abs(row.tail_up - (v > m + max(2, 0.1 * m)).mean()) < 1e-12
    b = {x.k: (x.bound, x.support) for x in stats.lower_bound(stats.histogram(spark.createDataFrame([(1, 5.0), (1, 7.0), (1, 7.0), (2, 5.0), (2, 9.0), (3, 4.0), (4, 0.0), (4, -1.0)], "k int, v double"), ["k"], "v"), ["k"]).collect()}
    assert b == {1: (7.0, 2), 2: (5.0, 2), 3: (None, 0)}


def test_checks_on_an_empty_table(spark):
    names = S.locus_header()
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in names) + ", ord long")
    found = qc.run_checks(empty).orderBy("no").collect()
    assert [f.status for f in found] == ["skip"] * 6 and qc.exit_code(found) == 0
    assert qc.exit_code([{"status": "fail"}]) == 2 and qc.exit_code([{"status": "warn"}]) == 0 and qc.exit_code([{"status": "warn"}], True) == 1
