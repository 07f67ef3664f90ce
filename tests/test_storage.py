from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline import with_models
from ledgerline.plans.models import MARTS
from ledgerline.session import fresh_path, shared_folder
from ledgerline.sources import sinks
from ledgerline.sources.schemas import RAW
from ledgerline.sources.tables import UnknownTable, from_catalog

from checks.compare import rows_of


def content(df):
    return rows_of(df.columns, df.collect())


@pytest.fixture(scope="module")
def stored(spark, tables):
    return sinks.create_raw(tables, fresh_path(spark, "test-raw"))


def test_stored_tables_keep_rows_and_types(tables, stored):
    for name in RAW:
        own = stored.ref(name).select(*RAW[name].names)
        assert own.schema == RAW[name]
        assert content(own) == content(tables.ref(name))


def test_models_over_stored_tables_are_the_same(tables, stored):
    again = with_models(stored)
    for name in MARTS:
        assert content(again.ref(name)) == content(tables.ref(name))


def test_creating_twice_gives_the_same_table(spark, tables):
    path = fresh_path(spark, "test-twice")
    for _ in range(2):
        stored = sinks.create_raw(tables, path, ["fact_interest_monthly", "dim_branch"])
    assert content(stored.ref("fact_interest_monthly").select(*RAW["fact_interest_monthly"].names)) == content(tables.ref("fact_interest_monthly"))
    assert stored.ref("dim_branch").count() == 25


def test_missing_column_is_refused(spark, tables):
    with pytest.raises(Exception):
        sinks.typed(tables.ref("dim_branch").drop("city"), RAW["dim_branch"])


def test_period_filter_reaches_the_files(stored):
    from ledgerline.plans.reference_questions import fee_revenue
    from ledgerline.functions.calendar import Period

    plan = fee_revenue(stored, period=Period.quarter(2000, 1))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(transaction_date,2000-01-01)" in pushed and "LessThan(transaction_date,2000-04-01)" in pushed
    read = plan[plan.index("ReadSchema"):]
    assert "posting_date" not in read and "branch_id" not in read


def test_materialised_marts_feed_later_models(spark, tables):
    path = fresh_path(spark, "test-marts")
    done = sinks.materialise(tables, list(MARTS), path)
    for name in MARTS:
        assert content(done.ref(name).select(*tables.ref(name).columns)) == content(tables.ref(name))
        assert all(path in file for file in done.ref(name).inputFiles())


def test_periods_skip_whole_folders(spark, tables, stored):
    from ledgerline.functions.calendar import Period, within
    from ledgerline.plans import metrics

    done = sinks.materialise(with_models(stored), ["fct_transactions", "fct_loans_monthly"], fresh_path(spark, "test-prune"))
    for df in (
        within(stored.ref("fact_daily_balance"), Period.month(2001, 3), "balance_date"),
        metrics.query(done, ["transaction_volume"], by=["transaction_type"], span=Period.quarter(2000, 2)),
        metrics.query(done, ["delinquency_rate_30d"], grain="month", span=Period.year(2000)),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = plan[plan.index("PartitionFilters"):].split("]")[0]
        assert ">=" in filters and "<" in filters
    whole = metrics.query(tables, ["transaction_volume"], by=["transaction_type"], span=Period.quarter(2000, 2))
    kept = metrics.query(done, ["transaction_volume"], by=["transaction_type"], span=Period.quarter(2000, 2))
    assert content(kept) == content(whole)


def test_catalog_tables(spark, tables):
    spark.sql("CREATE DATABASE IF NOT EXISTS lake")
    sinks.save_as_tables(tables, ["dim_customers"], "lake")
    found = from_catalog(spark, "lake", ["dim_customers"])
    assert content(found.ref("dim_customers")) == content(tables.ref("dim_customers"))
    with pytest.raises(UnknownTable):
        found.ref("fct_transactions")


def test_bucketed_ledger_is_netted_without_moving_it(spark, tables, no_broadcast):
    from ledgerline.plans.models import netted_transactions

    spark.sql("CREATE DATABASE IF NOT EXISTS lake")
    sinks.save_as_tables(tables, ["fact_transaction"], "lake", {"fact_transaction": ("transaction_id", 8)})
    found = from_catalog(spark, "lake", ["fact_transaction"])
    netted = netted_transactions(found)
    plan = netted._jdf.queryExecution().executedPlan().toString()
    anti = plan[plan.index("LeftAnti"):]
    assert "Bucketed: true" in anti and anti.index("FileScan") < anti.index("Exchange")
    assert content(netted.select("transaction_id", "amount")) == content(netted_transactions(tables).select("transaction_id", "amount"))


def test_question_records_survive_json(spark, tables):
    from checks.question_queries import AS_OF_DATES, QUESTIONS
    from ledgerline.plans.reference_questions import question_records

    records = question_records(tables, QUESTIONS, AS_OF_DATES[:2])
    path = fresh_path(spark, "test-questions")
    sinks.write_questions(records, path)
    back = sinks.read_questions(spark, path)
    assert content(back) == content(records)
    assert back.count() == 56 and back.where("answerable").count() == 44
    assert back.where("answerable AND expected_result IS NULL").count() == 0
    assert back.where("NOT answerable AND expected_result IS NOT NULL").count() == 0


def test_statements_of_the_records_give_their_answers(spark, tables):
    from checks.question_queries import AS_OF_DATES, QUESTIONS
    from ledgerline.plans.reference_questions import answers

    expected = {r.question_id: r.expected_result for r in answers(tables, QUESTIONS, AS_OF_DATES[:2]).collect()}
    session = tables.own_session()
    parts = [f"SELECT '{q.id}' AS id, round(CAST(answer AS double), 2) AS answer FROM ({q.sql})" for q in QUESTIONS if q.answerable]
    found = {r.id: r.answer for r in session.sql(" UNION ALL ".join(parts)).collect()}
    assert len(found) == 44 and found == pytest.approx(expected)
    assert all(q.text.endswith("?") for q in QUESTIONS) and len({q.text for q in QUESTIONS}) == len(QUESTIONS)


def test_result_log_survives_csv(spark):
    rows = [("c", "dev_in", 1, "q", True, "t", 'SELECT "a",\n 1', False, "", 1.5, None, "correct"), ("c", "dev_in", 2, "r", False, None, None, True, None, None, 2.0, "wrong, grain")]
    path = fresh_path(spark, "test-log")
    sinks.write_result_log(spark.createDataFrame(rows, sinks.RESULT_LOG), path)
    got = {r.question_id: r for r in sinks.read_result_log(spark, path).collect()}
    assert got["q"].generated_sql == 'SELECT "a", 1' and got["q"].model_result == 1.5 and got["q"].expected_result is None
    assert got["r"].failure_category == "wrong, grain" and got["r"].refused is True


def test_import_keeps_a_table_in_memory(tables):
    kept = tables.imported("dim_customers")
    assert kept.ref("dim_customers").storageLevel.useMemory
    assert content(kept.ref("dim_customers")) == content(tables.ref("dim_customers"))
    kept.release("dim_customers")
    assert not kept.ref("dim_customers").storageLevel.useMemory


def test_shared_folder_is_the_sessions(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder


def test_a_session_without_a_shared_folder_is_refused():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_a_mart_that_repeats_its_key_is_refused(spark, tables):
    from ledgerline.operators.joins import FanOut
    from ledgerline.plans.models import GRAINS

    twice = tables.ref("dim_customers").union(tables.ref("dim_customers"))
    with pytest.raises(FanOut, match="customer_id"):
        sinks.materialise(tables.extend({"dim_customers": lambda _: twice}), ["dim_customers"], fresh_path(spark, "test-repeated"), GRAINS)


def test_every_order_is_a_transaction(spark):
    from ledgerline.sources.projection import from_orders

    for scale in ("0.001", "0.01", "0.1"):
        folder = f"/root/testdata/sf{scale}"
        ledger = from_orders(spark, folder).ref("fact_transaction")
        assert ledger.where("NOT is_reversal").count() == spark.read.parquet(f"{folder}/orders.parquet").count()
    given = from_orders(spark, folder, as_of=date(1998, 12, 31), calendar_start=date(1998, 1, 1))
    bounds = given.ref("dim_date").agg(F.min("date_key"), F.max("date_key")).first()
    assert tuple(bounds) == (date(1998, 1, 1), date(1998, 12, 31))


def test_month_end_is_null_without_a_last_day(spark, tables):
    rows = [(1, date(2024, 2, 28), 10.0), (1, date(2024, 3, 31), 20.0), (1, date(2024, 3, 1), 40.0)]
    balances = spark.createDataFrame(rows, "account_id long, balance_date date, balance_amount double").withColumn("balance_amount", F.col("balance_amount").cast("decimal(12,2)"))
    month = {r.month_start: r for r in tables.extend({"fact_daily_balance": lambda _: balances}).ref("int_account_balances_monthly").collect()}
    assert month[date(2024, 2, 1)].month_end_balance is None
    assert (float(month[date(2024, 3, 1)].month_end_balance), month[date(2024, 3, 1)].avg_daily_balance) == (20.0, 30.0)


@pytest.fixture
def large_facts(spark, no_broadcast):
    """Every fact counts as large enough for a runtime filter."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    yield
    spark.conf.set(name, before)


def test_marts_lie_by_customer_within_a_month(spark, tables):
    path = fresh_path(spark, "test-clustered")
    done = sinks.materialise(tables, ["fct_loans_monthly"], path)
    for file in done.ref("fct_loans_monthly").inputFiles()[:20]:
        ids = [r[0] for r in spark.read.parquet(file).select("customer_id").collect()]
        assert ids == sorted(ids)


def test_a_filtered_dimension_drops_fact_rows_before_they_move(spark, tables, large_facts):
    from ledgerline.operators import security
    from ledgerline.plans import metrics
    from ledgerline.plans.models import marts

    done = sinks.materialise(tables, list(MARTS), fresh_path(spark, "test-bloom"))
    role = security.for_role(marts(done), security.standard_roles("NATION_7", "ASIA")["Restricted User"])
    by_region = metrics.query(marts(done), ["transaction_volume"], by=["customer__home_branch_name"], where={"customer__region": lambda c: c == "ASIA"})
    for df, same in (
        (role.ref("fct_transactions").groupBy("transaction_type").count(), None),
        (by_region, metrics.query(marts(tables), ["transaction_volume"], by=["customer__home_branch_name"], where={"customer__region": lambda c: c == "ASIA"})),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        fact = next(i for i, line in enumerate(lines) if "FileScan" in line and "/fct_transactions" in line)
        filtered = max(i for i, line in enumerate(lines[:fact]) if "Filter" in line and "might_contain(" in line and "customer_id" in line)
        # below the filter, apart from the subquery that builds it, there is only the scan: rows are dropped before any exchange of theirs
        depth = len(lines[fact]) - len(lines[fact].lstrip(" :+-"))
        own = [line for line in lines[filtered + 1 : fact] if len(line) - len(line.lstrip(" :+-")) == depth]
        assert not any("Exchange" in line for line in own)
        if same is not None:
            assert content(df) == content(same)
