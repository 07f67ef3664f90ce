"""Ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Safe division as a double; NULL where the denominator is zero or missing.
RATIO = "try_divide(CAST({0} AS double), CAST({1} AS double))"


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double")), digits)


def rounded(value: Column, digits: int = 2, half_even: bool = False) -> Column:
    """Half away from zero, the SQL rounding, or half to even."""
    return F.bround(value, digits) if half_even else F.round(value, digits)


def clamp(value: Column, low: Column | None = None, high: Column | None = None) -> Column:
    if low is not None:
        value = F.greatest(value, low)
    if high is not None:
        value = F.least(value, high)
    return value
