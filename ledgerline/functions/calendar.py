"""Calendar columns and half-open periods."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = ("day", "month", "quarter", "year")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def period_start_sql(grain: str, day: str) -> str:
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}")
    return day if grain == "day" else f"trunc({day}, '{grain}')"


def is_month_end(day: Column) -> Column:
    return day == F.last_day(day)


def is_quarter_end(day: Column) -> Column:
    return is_month_end(day) & (F.month(day) % 3 == 0)


def months_between_starts(earlier: Column, later: Column) -> Column:
    """Whole calendar months from one date's month to another's."""
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def calendar_columns(day: Column) -> list[Column]:
    return [
        day.alias("date_key"),
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day"),
        is_quarter_end(day).alias("is_quarter_end"),
        is_month_end(day).alias("is_month_end"),
    ]


@dataclass(frozen=True)
class Period:
    """A half-open date range. Written as two comparisons it reaches the parquet reader, which
    ``year(d) = 2000 and quarter(d) = 1`` does not."""

    start: date
    end: date

    @classmethod
    def year(cls, year: int) -> "Period":
        return cls(date(year, 1, 1), date(year + 1, 1, 1))

    @classmethod
    def quarter(cls, year: int, quarter: int) -> "Period":
        return cls.months(year, 3 * quarter - 2, 3)

    @classmethod
    def month(cls, year: int, month: int) -> "Period":
        return cls.months(year, month, 1)

    @classmethod
    def months(cls, year: int, first: int, n: int) -> "Period":
        ahead = first - 1 + n
        return cls(date(year, first, 1), date(year + ahead // 12, ahead % 12 + 1, 1))

    def contains(self, day: Column) -> Column:
        return (day >= F.lit(self.start)) & (day < F.lit(self.end))


def partition_of(day: str) -> str:
    """Name of the stored partition column holding the month of a date column."""
    return f"{day}_month"


def within(df: DataFrame, period: Period | None, day: str) -> DataFrame:
    """Rows of a period. Where the table is stored by the month of this date, whole folders are skipped."""
    if period is None:
        return df
    stored = partition_of(day)
    if stored in df.columns:
        first = F.lit(period.start.replace(day=1))
        df = df.where((F.col(stored) >= first) & (F.col(stored) < F.lit(period.end)))
    return df.where(period.contains(F.col(day)))
