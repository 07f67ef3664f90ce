"""What must not grow with the bank in one task or on the driver: rows taken apart, accounts that facts meet."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.models import with_models
from ledgerline.sources.folders import Folder
from ledgerline.sources.projection import daily_balances, interest, loan_payments, products
from ledgerline.sources.schemas import RAW
from ledgerline.sources.sinks import write_table
from ledgerline.sources.tables import Tables

START, END = date(2001, 1, 1), date(2001, 3, 31)


def accounts_in_one_file(spark, n=4000):
    """Open savings accounts and loans by turns, all read by one task."""
    k = F.col("id")
    values = {
        "account_id": k, "customer_id": k, "product_id": F.when(k % 2 == 0, 2).otherwise(3), "home_branch_id": F.lit(1),
        "open_date": F.lit(date(2000, 1, 1)), "status": F.lit("open"), "is_internal": F.lit(False), "write_off_flag": F.lit(False),
    }
    return spark.range(0, n, 1, 1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW["dim_account"]])


def test_balances_of_one_file_are_taken_apart_by_many_tasks_and_a_month_is_split(spark, tmp_path):
    rows = daily_balances(accounts_in_one_file(spark), F.lit(START), F.lit(END))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        write_table(rows, str(tmp_path), "fact_daily_balance")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    folder = Folder(spark, str(tmp_path))
    months = folder.children("fact_daily_balance")
    assert len([m for m in months if "=" in m]) == 3
    assert all(len(folder.children(f"fact_daily_balance/{m}")) > 1 for m in months if "=" in m)
    stored = spark.read.parquet(str(tmp_path / "fact_daily_balance"))
    assert stored.count() == 2000 * 90 and stored.select("account_id", "balance_date").distinct().count() == 2000 * 90


def test_loan_months_of_one_file_are_made_by_many_tasks(spark):
    account, product = accounts_in_one_file(spark), products(spark)
    paid = loan_payments(account, product, F.lit(END))
    earned = interest(account, product, daily_balances(account, F.lit(START), F.lit(END)), F.lit(END)).where("outstanding_loan_balance > 0")
    for rows in (paid, earned):
        assert rows.count() == 2000 * 15
        assert rows.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("mart", ["fct_loans_monthly", "fct_transactions", "fct_account_balances_monthly", "fct_interest_monthly"])
def test_accounts_are_not_broadcast_to_the_marts(spark, mart):
    account = accounts_in_one_file(spark, 20)
    raw = {name: (lambda schema: lambda t: t.spark.createDataFrame([], schema))(schema) for name, schema in RAW.items()}
    day = date(2001, 2, 1)
    rows = {
        "dim_branch": [(1, "One", "One", "North")],
        "fact_loan_payment": [(k, day, None, k) for k in range(1, 20, 2)] + [(None, day, None, 1), (77, day, None, 1)],
        "fact_transaction": [(k, k, day, day, 1, "deposit", None, False, False, None) for k in range(20)] + [(20, None, day, day, 1, "deposit", None, False, False, None)],
        "fact_daily_balance": [(k, day, None) for k in range(0, 20, 2)] + [(None, day, None)],
        "fact_interest_monthly": [(k, day, None, None, None) for k in range(20)] + [(None, day, None, None, None)],
    }
    made = {name: (lambda name: lambda t: t.spark.createDataFrame(rows[name], RAW[name]).coalesce(1))(name) for name in rows}
    found = with_models(Tables(spark, {**raw, **made, "dim_account": lambda t: account})).ref(mart)
    assert found.count() == {"fct_loans_monthly": 10, "fct_account_balances_monthly": 10}.get(mart, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [account_id" in plan or "SortMergeJoin [loan_account_id" in plan
