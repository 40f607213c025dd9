"""Percentages, rounding and null-safe sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(value: Column | str) -> Column:
    """Sum that is 0, not NULL, when every value is missing."""
    return F.coalesce(F.sum(value), F.lit(0))


def pct_diff(new: Column | str, base: Column | str) -> Column:
    """(new - base) / base * 100; NULL where the base is 0 or either side is missing."""
    new, base = _col(new), _col(base)
    return F.try_divide(new - base, base) * F.lit(100)


def guarded_pct(part: Column | str, whole: Column | str) -> Column:
    """part / whole * 100 where whole > 0, else 0."""
    part, whole = _col(part), _col(whole)
    return F.when(whole > 0, F.try_divide(part, whole) * F.lit(100)).otherwise(F.lit(0.0))


def round_pct(value: Column) -> Column:
    """Two decimals, ties to even."""
    return F.bround(value, 2)


def format_pct(value: Column) -> Column:
    """``12.34%``, rounding the exact binary value with ties to even and no thousands separator."""
    return F.concat(F.call_function("format_number", value, F.lit("0.00")), F.lit("%"))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
