from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.calendar import Period
from ledgerline.operators.joins import FanOut
from ledgerline.plans import entities
from ledgerline.plans import metrics as m
from ledgerline.plans.entities import AmbiguousPath
from ledgerline.plans.models import marts
from ledgerline.plans.report_measures import MEASURES, evaluate


@pytest.fixture(scope="module")
def sold(tables):
    return marts(tables)


def test_every_metric_alone_equals_all_together(sold):
    together = m.query(sold, list(m.METRICS)).first().asDict()
    assert len(m.METRICS) == 28
    for name in ("customer_inactivity_rate", "net_interest_margin", "charge_off_rate", "fee_revenue_net"):
        assert m.query(sold, [name]).first()[0] == together[name]
    assert all(v is not None for v in together.values())


def test_gross_exceeds_net_and_readings_differ(sold):
    row = m.query(sold, ["fee_revenue_gross", "fee_revenue_net", "delinquency_rate_30d", "delinquency_rate_30d_by_month_rows"]).first()
    assert row.fee_revenue_gross > row.fee_revenue_net
    assert row.delinquency_rate_30d > row.delinquency_rate_30d_by_month_rows


def test_one_scan_serves_all_metrics_of_a_model(sold):
    df = m.query(sold, ["fee_revenue_net", "fee_revenue_gross", "transaction_volume"], by=["transaction_type"])
    alone = m.query(sold, ["transaction_volume"], by=["transaction_type"])
    scans = lambda d: d._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans(df) == scans(alone)


def test_finer_grain_than_stored_is_refused(sold):
    with pytest.raises(ValueError):
        m.query(sold, ["net_interest_income"], grain="day")


def test_unknown_dimension_time_and_spine_are_refused(sold):
    with pytest.raises(ValueError):
        m.query(sold, ["transaction_volume"], by=["colour"])
    with pytest.raises(ValueError):
        m.query(sold, ["transaction_volume"], grain="month", time="signup_date")
    with pytest.raises(ValueError):
        m.query(sold, ["transaction_volume"], spine=True)


def test_entity_that_is_not_unique_elsewhere_is_refused(sold):
    with pytest.raises(FanOut):
        m.query(sold, ["transaction_volume"], by=["account__month_start"])


def test_an_attribute_that_two_models_tell_has_to_name_one(sold):
    with pytest.raises(AmbiguousPath, match="account__interest__product_id"):
        m.query(sold, ["transaction_volume"], by=["account__product_id"])
    with pytest.raises(AmbiguousPath):
        m.query(sold, ["transaction_volume"], where={"account__product_id": lambda c: c == 1})
    for name in ("account__interest__product_id", "account__account_balances__product_id"):
        total = m.query(sold, ["transaction_count"], by=[name]).agg(F.sum("transaction_count")).first()[0]
        assert total == sold.ref("fct_transactions").count()


def test_routes_are_the_shortest():
    loans, sold_in = m.MODELS["loans"], m.MODELS["transactions"]
    assert entities.route(m.MODELS, sold_in, "customer__region").steps == (("customer", "customers"),)
    assert entities.route(m.MODELS, sold_in, "customer__loan_status").steps == (("customer", "loans"),)
    with pytest.raises(ValueError):
        entities.route(m.MODELS, loans, "account__product_id")  # a loan leads to its customer, who has many accounts
    with pytest.raises(FanOut):
        entities.route(m.MODELS, sold_in, "customer__days_past_due")


@pytest.fixture
def two_steps(sold, spark, monkeypatch):
    """Visits know only the account; it leads to the customer, and the customer to the region."""
    rows = [(i, 1 + i % 40) for i in range(200)] + [(200, None), (201, -5)]
    visits = spark.createDataFrame(rows, "visit_id long, account_id long").withColumn("visit_date", F.lit("2000-05-05").cast("date"))
    model = m.SemanticModel("visits", ("visit_id",), "visit_date", "day", {"visit": "visit_id", "account": "account_id"}, {}, {"visits": ("count", "1")})
    models = {k: v for k, v in m.MODELS.items() if k != "interest"}  # so that one way is the shortest
    monkeypatch.setattr(m, "MODELS", {**models, "visits": model})
    monkeypatch.setitem(m.METRICS, "visit_count", m._simple("Visits", "visits", "visits"))
    return sold.extend({"visits": lambda _: visits}), rows


def test_a_route_of_two_steps(two_steps):
    tables, rows = two_steps
    assert str(entities.route(m.MODELS, m.MODELS["visits"], "customer__region")) == "account_balances by account > customers by customer"
    owner = {r.account_id: r.customer_id for r in tables.ref("fct_account_balances_monthly").select("account_id", "customer_id").distinct().collect()}
    region = {r.customer_id: r.region for r in tables.ref("dim_customers").collect()}
    expected = Counter(region.get(owner.get(a)) for _, a in rows)
    found = m.query(tables, ["visit_count"], by=["customer__region"]).collect()
    assert {r[0]: r[1] for r in found} == expected and len(found) == len(expected) > 2
    one = m.query(tables, ["visit_count"], by=["account__product_id", "customer__is_active"], where={"customer__region": lambda c: c == "ASIA"})
    assert one.agg(F.sum("visit_count")).first()[0] == expected["ASIA"]
    status = m.query(tables, ["visit_count"], by=["customer__loan_status"]).collect()
    assert sum(r["visit_count"] for r in status) == len(rows)


def test_two_equal_routes_of_two_steps_are_refused(two_steps, monkeypatch):
    import copy

    again = copy.copy(m.MODELS["account_balances"])
    monkeypatch.setattr(m, "MODELS", {**m.MODELS, "balances_again": again})
    with pytest.raises(AmbiguousPath, match="balances_again by account > customers by customer"):
        m.query(two_steps[0], ["visit_count"], by=["customer__region"])


def test_several_rows_per_key_never_multiply(sold):
    plain = m.query(sold, ["transaction_volume", "transaction_count"]).first()
    split = m.query(sold, ["transaction_volume", "transaction_count"], by=["customer__loan_status", "customer__region", "account__interest__product_id"])
    assert tuple(split.agg(F.sum("transaction_volume"), F.sum("transaction_count")).first()) == tuple(plain)


def test_dimension_must_exist_in_every_model(sold):
    with pytest.raises(ValueError):
        m.query(sold, ["transaction_volume", "total_loan_count"], by=["transaction_type"])


def test_spine_keeps_empty_periods(sold):
    df = m.query(sold, ["transaction_count"], grain="day", spine=True, where={"home_branch_name": lambda c: c == "nowhere"})
    assert df.count() == sold.ref("dim_dates").count()
    assert df.where("transaction_count IS NOT NULL").count() == 0


def test_spine_has_every_period_of_every_group(sold, tables):
    months = sold.ref("dim_dates").selectExpr("trunc(date_key, 'MM') AS m").distinct().count()
    fees = m.query(sold, ["fee_revenue_net", "transaction_count"], by=["home_branch_name"], grain="month", spine=True, fill=True)
    rows = fees.collect()
    assert len(rows) == 25 * months and all(r[2] is not None and r[3] is not None for r in rows)
    assert sum(r["transaction_count"] for r in rows) == tables.ref("fct_transactions").count()
    rates = m.query(sold, ["delinquency_rate_30d", "total_loan_count", "average_daily_balance"], grain="month", spine=True, fill=True).collect()
    assert len(rates) == months and {r["total_loan_count"] > 0 for r in rates} == {True, False}
    for r in rates:
        assert (r["delinquency_rate_30d"] is None) == (r["total_loan_count"] == 0)
    assert sum(r["average_daily_balance"] is None for r in rates) == months - 6


def test_spine_keeps_a_group_of_null_and_drops_periods_outside(sold, spark):
    one = sold.ref("fct_transactions").limit(1)
    late = [one.withColumns({"home_branch_name": F.lit(None).cast("string"), "posting_date": F.lit(d).cast("date")}) for d in ("1998-03-02", "2030-01-01", None)]
    more = sold.extend({"fct_transactions": lambda t: late[0].unionByName(late[1]).unionByName(late[2])})
    rows = m.query(more, ["transaction_count"], by=["home_branch_name"], grain="year", time="posting_date", spine=True, fill=True).collect()
    assert sum(r["transaction_count"] for r in rows) == 1 and {r["home_branch_name"] for r in rows} == {None}
    assert len(rows) == len({r["period"] for r in rows}) == sold.ref("dim_dates").selectExpr("year(date_key) AS y").distinct().count()
    span = m.query(more, ["transaction_count"], by=["home_branch_name"], grain="month", time="posting_date", span=Period.quarter(1998, 1), spine=True)
    assert sorted((r["period"].month, r["transaction_count"]) for r in span.collect()) == [(1, None), (2, None), (3, 1)]


def test_spine_refuses_what_it_cannot_hold(sold):
    with pytest.raises(ValueError, match="follows from the period"):
        m.query(sold, ["transaction_count"], by=["date__year"], grain="month", spine=True)
    with pytest.raises(ValueError, match="periods to fill"):
        m.query(sold, ["transaction_count"], grain="month", fill=True)


def test_spine_reads_its_result_once(sold, spark):
    df = m.query(sold, ["transaction_count"], by=["home_branch_name"], grain="month", spine=True, fill=True)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_ratio_over_nothing_is_null(sold):
    row = m.query(sold, ["delinquency_rate_30d"], where={"write_off_flag": lambda c: c}).first()
    assert row[0] is None


def test_customer_filter_excludes_unmatched_and_grouping_keeps_them(sold, spark):
    extra = sold.ref("fct_transactions").limit(1).withColumns({"customer_id": F.lit(-1).cast("long"), "transaction_id": F.lit(-1).cast("long")})
    more = sold.extend({"fct_transactions": lambda t: sold.ref("fct_transactions").unionByName(extra)})
    grouped = {r[0]: r[1] for r in m.query(more, ["transaction_count"], by=["customer__region"]).collect()}
    assert grouped[None] == 1
    filtered = m.query(more, ["transaction_count"], by=["customer__region"], where={"customer__region": lambda c: c.isNotNull()})
    assert None not in {r[0] for r in filtered.collect()}


def test_all_report_measures_are_there_and_agree_with_metrics(sold):
    assert len(MEASURES) == 10
    same = {
        "Transaction Volume": "transaction_volume", "Net Fee Revenue": "fee_revenue_net", "Active Customer Count": "active_customer_count",
        "Customer Inactivity Rate": "customer_inactivity_rate", "Average Daily Balance": "average_daily_balance",
        "Net Interest Income": "net_interest_income", "Net Interest Margin": "net_interest_margin",
        "Delinquency Rate 30D": "delinquency_rate_30d_by_month_rows", "Delinquency Rate 90D": "delinquency_rate_90d_by_month_rows",
        "Charge-off Rate": "charge_off_rate_by_month_rows",
    }
    for measure, metric in same.items():
        assert evaluate(sold, [measure]).first()[0] == pytest.approx(m.query(sold, [metric]).first()[0])


def test_replaced_filter_ignores_the_readers_filter(sold):
    plain = evaluate(sold, ["Active Customer Count"]).first()[0]
    against = evaluate(sold, ["Active Customer Count"], where={"is_active": lambda c: ~c}).first()[0]
    assert plain == against
    added = m.query(sold, ["active_customer_count"], where={"is_active": lambda c: ~c}).first()[0]
    assert added == 0


def test_measures_of_two_tables_are_refused(sold):
    with pytest.raises(ValueError):
        evaluate(sold, ["Net Fee Revenue", "Charge-off Rate"])


def test_snapshots_are_not_added_over_months(tables):
    mine = marts(tables)
    with pytest.raises(ValueError, match="grain"):
        m.implicit_totals(mine, "fct_account_balances_monthly", ["product_id"])
    with pytest.raises(ValueError, match="end of a month"):
        m.implicit_totals(mine, "fct_interest_monthly", ["product_id"], ["outstanding_loan_balance"])
    with pytest.raises(ValueError, match="cannot be totalled"):
        m.implicit_totals(mine, "fct_transactions", [], ["product_id"])


def test_a_balance_over_a_period_is_its_last(spark, tables):
    rows = [
        (1, "2024-01-01", 5.0, 1, -10.25), (1, "2024-02-01", 5.0, 1, 7.5), (1, "2024-03-01", 5.0, 1, None),  # the last with a balance counts
        (2, "2024-01-01", 5.0, 1, 100.0), (2, "2024-04-01", 5.0, 1, 200.0), (3, "2024-02-01", 5.0, 2, None), (4, "1969-12-01", 5.0, 2, -9999999999.99),
    ]
    df = spark.createDataFrame(rows, "account_id long, m string, avg_daily_balance double, product_id long, b double")
    df = df.selectExpr("account_id", "0L AS customer_id", "product_id", "CAST(m AS date) AS month_start", "avg_daily_balance", "CAST(b AS decimal(12,2)) AS month_end_balance")
    mine = marts(tables).extend({"fct_account_balances_monthly": lambda _: df})
    found = {(r[0], r[1].isoformat()): r[2] and float(r[2]) for r in m.implicit_totals(mine, "fct_account_balances_monthly", ["product_id"], grain="quarter").collect()}
    assert found == {(1, "2024-01-01"): 107.5, (1, "2024-04-01"): 200.0, (2, "2024-01-01"): None, (2, "1969-10-01"): -9999999999.99}
    whole = m.implicit_totals(mine, "fct_account_balances_monthly", grain="year")
    assert {r[0].year: float(r[1]) for r in whole.collect()} == {2024: 207.5, 1969: -9999999999.99}
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Window" not in plan
    with pytest.raises(ValueError, match="kept by month"):
        m.implicit_totals(mine, "fct_account_balances_monthly", grain="day")


def test_sketches_merge_over_any_grain(spark, tables):
    from ledgerline.plans import sketches

    rows = spark.range(0, 60_000).selectExpr(
        "id % 40000 AS customer_id", "id AS account_id", "if(id % 3 = 0, 'A', 'B') AS home_region", "'fee' AS transaction_type",
        "date_add(DATE '2023-01-01', CAST(id % 700 AS int)) AS transaction_date",
    ).unionByName(spark.sql("SELECT CAST(NULL AS long) AS customer_id, 1L AS account_id, 'C' AS home_region, 'fee' AS transaction_type, DATE '2023-01-01' AS transaction_date"))
    mine = sketches.with_sketches(marts(tables).extend({"fct_transactions": lambda _: rows}))
    name, bound = "sketch_transacting_customers", 5 * sketches.standard_error()
    for by, grain in (([], None), (["home_region"], None), (["home_region"], "quarter"), ([], "month"), (["transaction_type"], "year")):
        groups = [*by, *([F.expr(f"trunc(transaction_date, '{grain}') AS period")] if grain else [])]
        exact = {tuple(r)[:-1]: r[-1] for r in rows.where("customer_id IS NOT NULL").groupBy(*groups).agg(F.count_distinct("customer_id")).collect()}
        guess = {tuple(r)[:-1]: r[-1] for r in sketches.approximate_distinct(mine, name, by, grain).collect()}
        assert guess.keys() == exact.keys() and all(abs(guess[k] - n) <= 1 + bound * n for k, n in exact.items())
    # sums of monthly counts are no distinct count; merged sketches are
    monthly = sketches.approximate_distinct(mine, name, grain="month").agg(F.sum("estimate")).first()[0]
    assert monthly > 1.3 * 40_000 and sketches.approximate_distinct(mine, name, span=Period.year(2031)).first()[0] == 0
    with pytest.raises(ValueError):
        sketches.approximate_distinct(mine, name, ["customer_id"])
    with pytest.raises(ValueError):
        sketches.approximate_distinct(mine, name, grain="day")


def test_a_time_that_is_not_the_models_is_refused_first(tables):
    with pytest.raises(ValueError, match="has no time"):
        m.query(marts(tables), ["transaction_count"], time="signup_date", span=Period.year(2000))


def test_distinct_counts_do_not_multiply_rows(tables):
    for names in (["customer_count", "active_customer_count", "customer_inactivity_rate"], ["total_loan_count", "active_loan_count", "charge_off_rate"]):
        plan = m.query(marts(tables), names)._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan


def test_calendar_conditions_reach_the_files(tables):
    df = m.query(marts(tables), ["transaction_count"], where={"date__year": lambda c: c == 2000})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "transaction_date" in plan and ">= Subquery" in plan.replace("scalar-subquery", "Subquery")


def test_labels_name_every_metric():
    assert m.labels(["transaction_count"]) == {"transaction_count": "Transaction Count"} and set(m.labels()) == set(m.METRICS)
