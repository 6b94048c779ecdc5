"""Rounding and scaling helpers. Halves round up, so F.round must not be used for scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def round4(c: Column) -> Column:
    return F.floor(c * 10000 + 0.5) / 10000


def round0(c: Column) -> Column:
    return F.floor(c + 0.5)


def cents(c: Column) -> Column:
    """A two-decimal score as an exact integer, so that sums do not depend on row order."""
    return F.floor(c * 100 + 0.5).cast("long")


def thousands(c: Column) -> Column:
    return F.format_number(F.floor(c + 0.5), 0)


def log_compress(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def min_max(c: Column, low: Column, high: Column) -> Column:
    span = F.when(high > low, high - low)
    scaled = F.least(F.greatest((c - low) / span * 100, F.lit(0.0)), F.lit(100.0))
    return F.coalesce(scaled, F.lit(0.0))


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def trending_norm(c: Column) -> Column:
    return clamp01(F.coalesce(c, F.lit(0.0)) / 200)


def co_performer_norm(shared: Column) -> Column:
    return F.when(shared > 0, clamp01(0.5 + 0.5 * (shared - 1) / 3)).otherwise(F.lit(0.0))


def filled_count(columns: list[str]) -> Column:
    """How many of the columns hold a value: the completeness used to choose survivors."""
    total = F.lit(0)
    for name in columns:
        total = total + F.when(F.col(name).isNull() | (F.col(name).cast("string") == ""), 0).otherwise(1)
    return total


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.when(longest > 0, longest))
