"""Approximate distinct counts that can be added up: a sketch for each month and group, stored beside the marts.

An exact distinct count of a year has to look at the year's rows again. A sketch of a month is a few kilobytes whatever the month holds, and the
sketches of any months and groups merge into that of all of them. Opt-in: a metric stays exact unless it is asked for here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.calendar import GRAINS, Period, month_start, period_start_sql, within
from ledgerline.sources.tables import Loader, Tables

LG_K = 12  # 2^12 registers: up to 4 KB a sketch


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a merged estimate, 1.04 / sqrt(registers); 95 of 100 estimates lie within two of them."""
    return 1.04 / 2 ** (lg_k / 2)


@dataclass(frozen=True)
class Sketch:
    mart: str
    time: str                # date column of the mart
    counted: str
    by: tuple[str, ...]


SKETCHES = {
    "sketch_transacting_customers": Sketch("fct_transactions", "transaction_date", "customer_id", ("home_region", "transaction_type")),
    "sketch_transacting_accounts": Sketch("fct_transactions", "transaction_date", "account_id", ("home_region", "transaction_type")),
    "sketch_loans": Sketch("fct_loans_monthly", "month_start", "loan_account_id", ("product_id", "write_off_flag")),
}


def sketched(name: str, lg_k: int = LG_K) -> Loader:
    """``month_start``, the groups, and the sketch of what was counted. Rows combine in the tasks: what moves is a sketch a task, month and group.

    A group's sketch does not exist where it counted nothing but NULLs, which an estimate takes for 0 rows.
    """
    s = SKETCHES[name]

    def load(tables: Tables) -> DataFrame:
        rows = tables.ref(s.mart).where(F.col(s.counted).isNotNull())
        return rows.groupBy(month_start(F.col(s.time)).alias("month_start"), *s.by).agg(F.hll_sketch_agg(s.counted, lg_k).alias("sketch"))

    return load


def with_sketches(marts: Tables) -> Tables:
    return marts.extend({name: sketched(name) for name in SKETCHES})


def approximate_distinct(
    tables: Tables, name: str, by: Sequence[str] = (), grain: str | None = None, span: Period | None = None, alias: str = "estimate"
) -> DataFrame:
    """The estimated distinct count by any of the sketch's groups and any period of a month or longer."""
    s = SKETCHES[name]
    for d in by:
        if d not in s.by:
            raise ValueError(f"{name} is not kept by {d!r}")
    if grain and GRAINS.index(grain) < GRAINS.index("month"):
        raise ValueError(f"{name} is kept by month, not by {grain}")
    groups = [*by, *([F.expr(f"{period_start_sql(grain, 'month_start')} AS period")] if grain else [])]
    rows = within(tables.ref(name), span, "month_start")
    return rows.groupBy(*groups).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0).cast("long")).alias(alias))
