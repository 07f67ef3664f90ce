"""Batches appended by key, marts brought up to date by month, and sketches stored beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import register, scratch
from ledgerline import Tables
from ledgerline.functions.calendar import period_start_sql
from ledgerline.plans.increments import FED_BY, Warehouse
from ledgerline.plans.models import marts
from ledgerline.plans.sketches import SKETCHES, approximate_distinct, standard_error, with_sketches
from ledgerline.sources.batches import append_batch
from ledgerline.sources.schemas import RAW, STORED_BY
from ledgerline.sources.sinks import materialise
from ledgerline.sources.tables import from_parquet

LATE = "is_reversal AND transaction_id % 2 = 0 OR transaction_id % 50 = 7"


def appended_once(t: Tables) -> DataFrame:
    """The ledger from three batches: early rows, late ones twice under one name, and a third that brings late rows once more."""
    path, ledger = scratch(t.spark, "batches"), t.ref("fact_transaction")
    last = ledger.where("transaction_date >= DATE '2001-01-01'")
    append_batch(ledger.exceptAll(last).where(f"NOT ({LATE})"), path, "fact_transaction", "early")
    for _ in range(2):
        append_batch(ledger.exceptAll(last).where(LATE), path, "fact_transaction", "late")
    append_batch(last.unionByName(ledger.exceptAll(last).where(f"({LATE}) AND transaction_id % 3 = 0")), path, "fact_transaction", "last")
    return from_parquet(t.spark, path).ref("fact_transaction").select(*RAW["fact_transaction"].names)


register(
    "batches_appended_once_by_key",
    appended_once,
    "SELECT * FROM fact_transaction",
    real="amount",
    dates="transaction_date, posting_date",
)


def in_batches(t: Tables) -> Tables:
    """A warehouse loaded without late rows, which two batches then bring: reversals and scattered originals, and months of the other facts."""
    spark = t.spark
    store = Warehouse(spark, scratch(spark, "raw"), scratch(spark, "marts"))
    late = {
        "fact_transaction": LATE,
        "fact_daily_balance": "dayofmonth(balance_date) = 15 AND account_id % 3 = 0",
        "fact_loan_payment": "payment_date >= DATE '2001-03-01'",
        "fact_interest_monthly": "account_id % 5 = 1 AND month(month_start) = 2",
    }
    store.load("base", t.extend({name: (lambda name: lambda _: t.ref(name).where(f"NOT ({late[name]})"))(name) for name in late}))
    store.apply("ledger", {"fact_transaction": t.ref("fact_transaction").where(late["fact_transaction"])})
    for _ in range(2):
        store.apply("others", {name: t.ref(name).where(rows) for name, rows in late.items() if name != "fact_transaction"})
    return store.marts()


register(
    "late_postings_and_reversals_in_the_mart",
    lambda t: in_batches(t).ref("fct_transactions").drop("transaction_date_month"),
    "SELECT * FROM fct_transactions",
    real="amount",
    dates="transaction_date, posting_date",
)

TOTALS = {
    "fct_transactions": "amount",
    "fct_account_balances_monthly": "avg_daily_balance",
    "fct_loans_monthly": "days_past_due",
    "fct_interest_monthly": "outstanding_loan_balance",
}


def totals_by_month(t: Tables) -> DataFrame:
    marts = in_batches(t)
    parts = [
        marts.ref(mart).groupBy(F.trunc(STORED_BY[mart], "MM").alias("month")).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col(column).cast("double")), 2).alias("total")
        ).select(F.lit(mart).alias("mart"), "month", "n", "total")
        for mart, column in TOTALS.items()
    ]
    return reduce(DataFrame.union, parts)


register(
    "marts_after_batches_by_month",
    totals_by_month,
    " UNION ALL ".join(
        f"""SELECT '{mart}' AS mart, CAST(date_trunc('month', {STORED_BY[mart]}) AS DATE) AS month, count(*) AS n,
                   round(sum(CAST({column} AS DOUBLE)), 2) AS total FROM {mart} GROUP BY 2"""
        for mart, column in TOTALS.items()
    ),
    dates="month",
)


def estimated(name: str, by: str, grain: str, exact: str):
    """Stored sketches merged by group and period, beside the exact count: is the estimate within five standard errors of it, and one?"""

    def run(t: Tables) -> DataFrame:
        stored = materialise(with_sketches(marts(t)), [name], scratch(t.spark, "sketches"))
        guess = approximate_distinct(stored, name, [by], grain)
        s = SKETCHES[name]
        period = F.expr(f"{period_start_sql(grain, s.time)} AS period")
        counted = t.ref(s.mart).groupBy(F.col(by).alias("_by"), period).agg(F.count_distinct(s.counted).alias(exact))
        near = F.abs(F.col("estimate") - F.col(exact)) <= 1 + 5 * standard_error() * F.col(exact)
        same = (F.col("_by") == F.col(by)) & (F.col("_period") == F.col("period"))
        return counted.withColumnRenamed("period", "_period").join(guess, same, "left").select(F.col("_by").alias(by), F.col("_period").alias("period"), exact, F.coalesce(near, F.lit(False)).alias("estimate_is_near"))

    return run


for _name, _by, _grain, _exact, _sql in (
    ("sketch_transacting_customers", "home_region", "year", "customers", "count(DISTINCT customer_id) AS customers, TRUE AS estimate_is_near FROM fct_transactions"),
    ("sketch_transacting_accounts", "transaction_type", "quarter", "accounts", "count(DISTINCT account_id) AS accounts, TRUE AS estimate_is_near FROM fct_transactions"),
    ("sketch_loans", "product_id", "month", "loans", "count(DISTINCT loan_account_id) AS loans, TRUE AS estimate_is_near FROM fct_loans_monthly"),
):
    register(
        f"{_name}_by_{_grain}",
        estimated(_name, _by, _grain, _exact),
        f"SELECT {_by}, CAST(date_trunc('{_grain}', {SKETCHES[_name].time}) AS DATE) AS period, {_sql} GROUP BY 1, 2",
        dates="period",
    )
assert set(TOTALS) == set(FED_BY)
