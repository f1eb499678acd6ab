"""Clamps and rounding (MTH1-MTH2).

``least``/``greatest`` skip NULL and order NaN above everything, so a bare ``least(x, 1)`` would turn a
missing KPI into a perfect one; every clamp here keeps NULL/NaN as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def cap(c, hi: float) -> Column:
    x = _c(c)
    return F.when(_missing(x), F.lit(None).cast("double")).otherwise(F.least(x, F.lit(float(hi))))


def floor_at(c, lo: float) -> Column:
    x = _c(c)
    return F.when(_missing(x), F.lit(None).cast("double")).otherwise(F.greatest(x, F.lit(float(lo))))


def clamp(c, lo: float, hi: float) -> Column:
    return cap(floor_at(c, lo), hi)


DIGITS = 6  # decimals that results are compared at


def stable(c, digits: int = DIGITS) -> Column:
    """Round to a fixed number of decimals, so that the noise of float sums does not show when results
    are compared. Same arithmetic as ``stable_sql`` (ties away from zero); + 0.0 drops -0.0."""
    k = float(10 ** digits)
    return (F.round(_c(c).cast("double") * F.lit(k)) / F.lit(k) + F.lit(0.0)).cast("double")


def stable_sql(expr: str, digits: int = DIGITS) -> str:
    """The same rounding as ``stable`` written as SQL text, for the oracle."""
    k = f"{float(10 ** digits):.1f}"
    return f"CAST((ROUND(CAST({expr} AS DOUBLE) * {k}) / {k} + CAST(0.0 AS DOUBLE)) AS DOUBLE)"
