"""The row kernels as vectorised functions for SQL: ``register(spark)``, then
``select repeat_run(seq, array('CAG')).labels``, ``competing_period(...)``, ``mod_sites(...)``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..kernels import basemods, units


@F.pandas_udf("start int, end int, n_units int, labels string")
def repeat_run(seq: pd.Series, canonical: pd.Series) -> pd.DataFrame:
    """The tract of a sequence for motifs of one length; nulls where there is none."""
    out = []
    for s, m in zip(seq, canonical):
        run = units.motifs(len(m[0]), tuple(m)).decompose(s.upper()) if s and m is not None and len(m) else None
        out.append((run.start, run.end, len(run), run.labels) if run else (None, None, None, None))
    return pd.DataFrame(out, columns=["start", "end", "n_units", "labels"])


@F.pandas_udf("int")
def competing_period(seq: pd.Series, unit_len: pd.Series, periods: pd.Series) -> pd.Series:
    return pd.Series([units.competing_period(s, int(n), [int(x) for x in p]) if s else None for s, n, p in zip(seq, unit_len, periods)], dtype="object")


@F.pandas_udf("array<struct<qpos:int,p_m:double,p_h:double>>")
def mod_sites(seq: pd.Series, reverse: pd.Series, mm: pd.Series, ml: pd.Series) -> pd.Series:
    made = (basemods.cytosine_sites(s or "", bool(r), m, None if x is None else [int(b) for b in x]) for s, r, m, x in zip(seq, reverse, mm, ml))
    return pd.Series([[{"qpos": q, "p_m": a, "p_h": b} for q, a, b in sites] for sites in made], dtype="object")


def register(spark: SparkSession) -> None:
    for f in (repeat_run, competing_period, mod_sites):
        spark.udf.register(f.__name__, f)
