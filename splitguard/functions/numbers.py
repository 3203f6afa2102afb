"""Number formats used in messages and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(fraction: Column) -> Column:
    """Percentage with one decimal, ties to even."""
    return F.bround(fraction * 100, 1)


def percent_half_up(fraction: Column) -> Column:
    """Percentage with one decimal as a chart label shows it, ties upwards."""
    return F.floor(fraction * 1000 + 0.5) / 10


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
