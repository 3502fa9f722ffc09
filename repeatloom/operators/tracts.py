"""The sequence kernels as DataFrame operators.

Row kernels run inside the tasks that hold the rows (no shuffle). The consensus first
counts equal reads of an allele, before the shuffle, and takes the counted reads together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import basemods, consensus as cons
from ..kernels.units import Run, motifs
from .groups import runs_of

RUN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("n_units", T.IntegerType()), T.StructField("labels", T.StringType()), T.StructField("unit_at", T.ArrayType(T.IntegerType())), T.StructField("phase", T.StringType()), T.StructField("bridged", T.BooleanType())])
REGIONS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SITES = T.ArrayType(T.StructType([T.StructField("qpos", T.IntegerType()), T.StructField("p_m", T.DoubleType()), T.StructField("p_h", T.DoubleType())]))


def _with_column(df: DataFrame, name: str, kind: T.DataType, inputs: list[Column], kernel: Callable) -> DataFrame:
    """``df`` with a column that ``kernel`` makes from each row's ``inputs``."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = [f"_{k}" for k in range(len(inputs))]
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    arrow = to_arrow_type(kind)
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(width + k).to_pylist() for k in range(len(names))))
            made = pa.array([kernel(*row) for row in rows], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], made], names=[*batch.schema.names[:width], name])

    return df.select("*", *[c.alias(n) for c, n in zip(inputs, names)]).mapInArrow(run, schema)


def _motif_inputs(seq: str, unit_len: str, canonical: Column, pathogenic: Column | None, benign: Column | None, interruption: Column | None) -> list[Column]:
    none = F.expr("cast(array() as array<string>)")
    return [F.col(seq), F.col(unit_len), canonical, *[none if m is None else m for m in (pathogenic, benign, interruption)]]


def _motifs(unit_len, *lists):
    return motifs(unit_len, *(tuple(m or ()) for m in lists))


@lru_cache(maxsize=8192)
def _decomposed(seq: str, lists: tuple, window: tuple | None = None, most: int | None = None) -> Run | None:
    """Equal short sequences, of which amplicons have many, are walked once a worker."""
    return motifs(*lists).decompose(seq, window, most)


#: Bases of the longest sequence whose tract a worker holds.
HELD_BASES = 2000


def _run_of(seq: str, lists: tuple, window: tuple | None = None, most: int | None = None) -> Run | None:
    made = _decomposed if len(seq) <= HELD_BASES else _decomposed.__wrapped__
    return made(seq.upper(), lists, window, most)


def decompose(df: DataFrame, seq: str, unit_len: str, canonical: Column, pathogenic: Column | None = None, benign: Column | None = None, interruption: Column | None = None, window: Column | None = None, max_bp: Column | None = None) -> DataFrame:
    """Adds ``run``: the tract as labelled units, null where there is none.

    window: struct(start, end) in the sequence; with max_bp, bounds for long motifs.
    """
    inputs = _motif_inputs(seq, unit_len, canonical, pathogenic, benign, interruption)
    inputs += [F.lit(None).cast("struct<start:int,end:int>") if window is None else window, F.lit(None).cast("int") if max_bp is None else max_bp]

    def kernel(s, n, c, p, b, i, w, most):
        run = _run_of(s, (n, *(tuple(m or ()) for m in (c, p, b, i))), (w["start"], w["end"]) if w else None, most) if s else None
        return run and {"start": run.start, "end": run.end, "n_units": len(run), "labels": run.labels, "unit_at": run.unit_at, "phase": run.phase and run.phase[1], "bridged": run.bridged}

    return _with_column(df, "run", RUN, inputs, kernel)


def regions(df: DataFrame, seq: str, unit_len: str, canonical: Column, **more: Column) -> DataFrame:
    """Adds ``regions``: stretches of motif rotations."""
    inputs = _motif_inputs(seq, unit_len, canonical, *[more.get(k) for k in ("pathogenic", "benign", "interruption")])
    return _with_column(df, "regions", REGIONS, inputs, lambda s, n, *m: [{"start": a, "end": b} for a, b in _motifs(n, *m).regions((s or "").upper())])


def crossed(df: DataFrame, seq: str, unit_len: str, canonical: Column, from_left: Column, window: Column, **more: Column) -> DataFrame:
    """Adds ``lower_bound_units`` of reads that end in the tract."""
    inputs = [*_motif_inputs(seq, unit_len, canonical, *[more.get(k) for k in ("pathogenic", "benign", "interruption")]), from_left, window]

    def kernel(s, n, c, p, b, i, left, w):
        return _motifs(n, c, p, b, i).crossed((s or "").upper(), (w["start"], w["end"]) if w else None, left)

    return _with_column(df, "lower_bound_units", T.IntegerType(), inputs, kernel)


def longest_exact(seq: Column, motif: Column, unit_len: Column) -> Column:
    """Units of the longest exact run of a motif, as an expression."""
    runs = F.regexp_extract_all(seq, F.concat(F.lit("((?:"), motif, F.lit(")+)")), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)) / unit_len, F.lit(0)).cast("long")


def modifications(df: DataFrame) -> DataFrame:
    """Adds ``sites`` (qpos, p_m, p_h) from seq, reverse, mm, ml, mn; null where a tag is absent or refused."""
    inputs = [F.col(c) for c in ("seq", "reverse", "mm", "ml", "mn")]

    def kernel(seq, reverse, mm, ml, mn):
        return [{"qpos": q, "p_m": m, "p_h": h} for q, m, h in basemods.cytosine_sites(seq or "", bool(reverse), mm, ml, mn)]

    return _with_column(df, "sites", SITES, inputs, kernel)


def consensus(reads: DataFrame, keys: list[str], seq: str, unit_len: str, canonical: Column, units: Column, order: str = "ord") -> DataFrame:
    """(keys, consensus, labels, n_reads): the allele's sequence, or its representative's run.

    The representative has the least (distance from the median count, shortfall, noise), then the first.
    """
    rows = reads.select(*keys, F.col(seq).alias("_seq"), F.col(unit_len).alias("_len"), canonical.alias("_motifs"), units.cast("double").alias("_units"), F.col(order).alias("_ord"))
    content = [*keys, "_seq", "_len", "_motifs", "_units"]
    ballots = rows.groupBy(*content).agg(F.min("_ord").alias("_ord"), F.count("*").alias("_weight"))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in runs_of(batches, n):
            made = [(*g[0][:n], *_voted(tuple((r[n], r[n + 1], tuple(r[n + 2]), r[n + 3], r[n + 5]) for r in g))) for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

    schema = T.StructType([*(reads.schema[k] for k in keys), T.StructField("consensus", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("n_reads", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_type

    types, names = [to_arrow_type(f.dataType) for f in schema.fields], schema.fieldNames()
    return ballots.repartition(*keys).sortWithinPartitions(*keys, "_ord", "_seq").mapInArrow(run, schema)


@lru_cache(maxsize=1024)
def _voted(rows: tuple) -> tuple[str | None, str | None, int]:
    """Consensus, its labels and the reads with a run, of rows (seq, unit length, motifs, units, weight) in order."""
    lists = (rows[0][1], rows[0][2])
    counts = np.sort(np.repeat([r[3] for r in rows], [r[4] for r in rows]))
    centre = (counts[(len(counts) - 1) // 2] + counts[len(counts) // 2]) / 2
    found = [(r, x) for r in rows if (x := _run_of(r[0], lists))]
    if not found:
        return None, None, 0
    members = [cons.Read(r[0][x.start : x.end], x, int(r[3]), r[4]) for r, x in found]
    rep = min(range(len(found)), key=lambda k: (abs(found[k][0][3] - centre), cons.shortfall(members[k].units, len(members[k].run)), members[k].run.noise, k))
    best = cons.consensus(members, motifs(*lists), rep) or members[rep].seq
    again, shown = _run_of(best, lists), members[rep].run
    return best, (again if again and 2 * len(again) >= len(shown) else shown).labels, sum(m.weight for m in members)
