"""Numbers as text, and lenient parsing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "."


def fixed(x: Column, places: int) -> Column:
    """Fixed decimals, halves to even; missing prints as a dot."""
    pattern = "0." + "0" * places if places else "0"
    return F.coalesce(F.call_function("format_number", x.cast("double"), F.lit(pattern)), F.lit(MISSING))


def whole(x: Column) -> Column:
    return F.coalesce(x.cast("long").cast("string"), F.lit(MISSING))


def flag(x: Column) -> Column:
    return F.coalesce(x.cast("int").cast("string"), F.lit(MISSING))


def text(x: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(MISSING))


def general(x: Column) -> Column:
    """Up to six significant digits without trailing zeros, for magnitudes from 1e-4 to 1e6."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.when(x == 0, 1.0).otherwise(F.abs(x)))).cast("int"))
    shown = F.bround(x, 6)
    kept = F.when(digits <= 5, F.bround(x, 5)).otherwise(shown)
    s = F.call_function("format_number", kept, F.lit("0.######"))
    return F.when(s == "-0", "0").otherwise(s)


def number(x: Column) -> Column:
    """A double from text: missing marks and what is no number are null."""
    plain = F.regexp_replace(F.trim(x), r"(?<=\d)_(?=\d)", "")
    return F.when(plain.isin("", MISSING), None).otherwise(F.try_cast(plain, "double") if hasattr(F, "try_cast") else plain.try_cast("double"))


def count(x: Column) -> Column:
    return F.floor(number(x)).cast("long")


def percent1(x: Column) -> Column:
    return F.call_function("format_number", 100 * x, F.lit("0.0"))
