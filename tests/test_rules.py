from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.calendar import Period, months_between_starts, period_start_sql
from ledgerline.functions.numbers import clamp, percent, rounded
from ledgerline.operators import rules
from ledgerline.sources.projection import literal_rows
from ledgerline.sources.schemas import PRODUCTS, RAW


def test_calendar_matches_python_dates(spark):
    found = {r.date_key: r for r in rules.calendar(spark, date(2023, 12, 30), date(2024, 7, 1)).collect()}
    day = date(2023, 12, 30)
    while day <= date(2024, 7, 1):
        r, after = found.pop(day), day + timedelta(days=1)
        assert (r.year, r.quarter, r.month, r.day) == (day.year, (day.month - 1) // 3 + 1, day.month, day.day)
        assert r.is_month_end == (after.month != day.month)
        assert r.is_quarter_end == (r.is_month_end and day.month % 3 == 0)
        day = after
    assert not found


@pytest.mark.parametrize(
    "period, start, end",
    [
        (Period.year(2000), date(2000, 1, 1), date(2001, 1, 1)),
        (Period.quarter(2000, 4), date(2000, 10, 1), date(2001, 1, 1)),
        (Period.quarter(2000, 1), date(2000, 1, 1), date(2000, 4, 1)),
        (Period.month(2000, 12), date(2000, 12, 1), date(2001, 1, 1)),
        (Period.months(2000, 11, 3), date(2000, 11, 1), date(2001, 2, 1)),
    ],
)
def test_periods_are_half_open(period, start, end):
    assert (period.start, period.end) == (start, end)


def test_unknown_grain_is_refused():
    with pytest.raises(ValueError):
        period_start_sql("week", "d")


def test_monthly_series_runs_to_the_end_month(spark):
    df = spark.createDataFrame(
        [(1, date(2024, 1, 20), date(2024, 3, 1)), (2, date(2024, 5, 5), date(2024, 5, 4)), (3, date(2024, 5, 5), date(2024, 4, 30))],
        "id int, opened date, ended date",
    )
    series = rules.monthly_series(df, F.col("opened"), F.col("ended"))
    found = [(r.id, r.month_index, r.month_start) for r in series.orderBy("id", "month_index").collect()]
    assert found == [(1, 0, date(2024, 1, 1)), (1, 1, date(2024, 2, 1)), (1, 2, date(2024, 3, 1)), (2, 0, date(2024, 5, 1))]


def test_delinquency_ramp(spark):
    months = [date(2024, m, 1) for m in range(1, 9)]
    df = spark.createDataFrame([(m, date(2024, 8, 15)) for m in months], "m date, w date")
    days = rules.days_past_due_before_write_off(F.col("m"), F.col("w"))
    assert [r[0] for r in df.orderBy("m").select(days).collect()] == [0, 0, 0, 30, 30, 60, 90, 120]


def test_signs_and_close_dates(spark):
    df = spark.createDataFrame([("fee", 5.0, None), ("deposit", -5.0, date(2020, 1, 1)), ("purchase", 5.0, None)], "t string, a double, c date")
    got = df.select(rules.signed_amount(F.col("t"), F.col("a")), rules.effective_close(F.col("c"), date(2024, 1, 1))).collect()
    assert [tuple(r) for r in got] == [(-5.0, date(2024, 1, 1)), (5.0, date(2020, 1, 1)), (-5.0, date(2024, 1, 1))]


def test_interest_model(spark):
    months = spark.createDataFrame(
        [(1, date(2024, 1, 1), 0, "Personal Loan", 6000), (1, date(2024, 2, 1), 30, "Personal Loan", 6000), (2, date(2024, 1, 1), 400, "Mortgage", 200000)],
        "account_id long, month_start date, month_index int, product_name string, origination long",
    )
    got = [(float(r.interest_income), float(r.outstanding_loan_balance)) for r in rules.loan_interest(months).orderBy("account_id", "month_start").collect()]
    assert got == [(42.0, 6000.0), (21.0, 3000.0), (0.0, 0.0)]
    products = literal_rows(spark, PRODUCTS, RAW["dim_product"])
    accounts = spark.createDataFrame([(1, 2), (2, 5)], "account_id long, product_id long")
    balances = spark.createDataFrame(
        [(1, date(2024, 1, 1), 1000.0), (1, date(2024, 1, 2), 3000.0), (2, date(2024, 1, 1), 9999.0)],
        "account_id long, balance_date date, balance_amount double",
    )
    expense = {r.account_id: float(r.interest_expense) for r in rules.deposit_interest(balances, accounts, products).collect()}
    assert expense == {1: 3.0, 2: 0.0}


def test_activity_window_is_inclusive_and_counts_any_row(spark):
    transactions = spark.createDataFrame(
        [(1, date(2024, 4, 1)), (2, date(2024, 3, 31)), (3, date(2025, 1, 1)), (9, date(2024, 6, 1))], "account_id long, transaction_date date"
    )
    accounts = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (9, None)], "account_id long, customer_id long")
    active = rules.active_customer_ids(transactions, accounts, date(2024, 6, 30), 90)
    assert sorted(r[0] for r in active.collect()) == [10, 30]


def test_rounding_and_clamping(spark):
    one = spark.range(1)
    row = one.select(
        rounded(F.lit(2.675).cast("decimal(6,3)")), rounded(F.lit(2.5), 0, half_even=True), clamp(F.lit(9), F.lit(0), F.lit(3)),
        clamp(F.lit(-1), low=F.lit(0)), percent(F.lit(1), F.lit(3)), percent(F.lit(1), F.lit(0)),
        months_between_starts(F.lit(date(2023, 11, 30)), F.lit(date(2024, 2, 1))),
    ).first()
    assert [float(x) if x is not None else None for x in row] == [2.68, 2.0, 3.0, 0.0, 33.33, None, 3.0]


def test_activity_is_an_existence_join(spark, tables):
    ids = spark.createDataFrame([(1,), (1,), (None,), (3,)], "customer_id long")
    customers = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (3, "d")], "customer_id long, n string")
    flagged = rules.with_activity(customers, ids)
    assert sorted((r.n, r.is_active) for r in flagged.collect()) == [("a", True), ("b", False), ("c", False), ("d", True), ("d", True)]
    plan = tables.ref("dim_customer")._jdf.queryExecution().executedPlan().toString()
    assert "ExistenceJoin" in plan and "LeftOuter" not in plan and "NestedLoop" not in plan
