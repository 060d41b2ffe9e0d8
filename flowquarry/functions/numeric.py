"""Numeric clean-up and scoring expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def is_finite(c: Column) -> Column:
    """True for numbers, false for null, NaN and both infinities."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def finite_or_zero(c: Column) -> Column:
    return F.when(is_finite(c), c).otherwise(F.lit(0.0))


def to_double(c: Column, default: float | None = None) -> Column:
    """Text to number without failing on bad text."""
    value = c.try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def first_finite(candidates: list[Column], default: float = 0.0) -> Column:
    """The first candidate holding a finite number."""
    return F.coalesce(*[finite_or_null(c) for c in candidates], F.lit(default))


def safe_log1p(c: Column) -> Column:
    """``log1p`` where it is defined, null elsewhere."""
    return F.when(c > -1.0, F.log1p(c))


def unit_probability(p: Column) -> Column:
    """Values above one are percentages."""
    return F.when(p > 1.0, p / 100.0).otherwise(p)


def risk_band(p: Column) -> Column:
    return F.when(p > 0.8, "high").when(p > 0.5, "medium").otherwise("low")


def share(part: Column, whole: Column) -> Column:
    """part / whole, zero where whole is zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def round6(c: Column) -> Column:
    """Six places and no negative zero, for results compared across engines."""
    return F.round(c, 6) + F.lit(0.0)
