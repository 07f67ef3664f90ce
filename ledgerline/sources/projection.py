"""The nine raw banking tables derived from the generic order tables.

Plain integer arithmetic on keys, so any SQL engine can derive the same rows. Account and reversal
ids start at 10**15 offsets: they stay unique for up to that many customers or orders.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.functions.calendar import month_start
from ledgerline.operators import rules
from ledgerline.operators.joins import by_key, lookup, spread
from ledgerline.sources.schemas import MONEY, PRODUCTS, RAW
from ledgerline.sources.tables import Tables

FIRST_OPENING = date(1995, 1, 1)  # accounts and customers are dated from here on
BALANCE_MONTHS = 6                # months of daily balances up to the as-of date

LOAN_IDS = 10**15
INTERNAL_IDS = 2 * 10**15
REVERSAL_IDS = 10**15


def _plus(start: date, days: Column) -> Column:
    return F.date_add(F.lit(start), days.cast("int"))


def _nullable(kind: str) -> Column:
    return F.lit(None).cast(kind)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """A small constant table as part of the plan, so Spark knows its size and can broadcast it."""
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)]) for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def products(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, PRODUCTS, RAW["dim_product"])


def branches(nation: DataFrame, region: DataFrame) -> DataFrame:
    name = F.col("n_name")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("branch_id"),
        name.alias("branch_name"),
        name.alias("city"),
        F.col("r_name").alias("region"),
    )


def accounts(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Deposit and card accounts, loans and internal accounts in one table."""
    k = F.col("c_custkey")
    home = F.col("c_nationkey").cast("long").alias("home_branch_id")
    closed = k % 20 == 0
    everyday = customer.select(
        (k + 1).alias("account_id"),
        k.alias("customer_id"),
        F.when(k % 3 == 0, 1).when(k % 3 == 1, 2).otherwise(5).cast("long").alias("product_id"),
        home,
        _plus(FIRST_OPENING, k % 365 + k % 30).alias("open_date"),
        F.when(closed, _plus(date(1995, 3, 2), k % 365 + k % 470)).alias("close_date"),
        F.when(closed, "closed").otherwise("open").alias("status"),
        F.lit(False).alias("is_internal"),
        F.lit(False).alias("write_off_flag"),
        _nullable("date").alias("write_off_date"),
    )
    lost = k % 28 == 0
    loans = customer.where(k % 4 == 0).select(
        (k + LOAN_IDS).alias("account_id"),
        k.alias("customer_id"),
        F.when(k % 8 == 0, 3).otherwise(4).cast("long").alias("product_id"),
        home,
        _plus(date(1999, 1, 1), k % 700).alias("open_date"),
        _nullable("date").alias("close_date"),
        F.when(lost, "closed").otherwise("open").alias("status"),
        F.lit(False).alias("is_internal"),
        lost.alias("write_off_flag"),
        F.when(lost, _plus(date(2001, 1, 1), k % 200)).alias("write_off_date"),
    )
    internal = supplier.select(
        (F.col("s_suppkey") + INTERNAL_IDS).alias("account_id"),
        _nullable("long").alias("customer_id"),
        F.lit(6).cast("long").alias("product_id"),
        F.lit(0).cast("long").alias("home_branch_id"),
        F.lit(FIRST_OPENING).alias("open_date"),
        _nullable("date").alias("close_date"),
        F.lit("open").alias("status"),
        F.lit(True).alias("is_internal"),
        F.lit(False).alias("write_off_flag"),
        _nullable("date").alias("write_off_date"),
    )
    return everyday.unionByName(loans).unionByName(internal)


def transactions(orders: DataFrame, customer: DataFrame, as_of: Column) -> DataFrame:
    """Originals, one for each order, and for some of them a reversal some days later, if that is by the as-of date."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    home = customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = lookup(orders, by_key(home), "o_custkey")
    internal = k % 20 == 0
    priority = F.col("o_orderpriority")
    kind = (
        F.when(priority == "1-URGENT", "fee")
        .when(priority == "2-HIGH", "deposit")
        .when(priority == "3-MEDIUM", "withdrawal")
        .otherwise("purchase")
    )
    originals = rows.select(
        k.alias("transaction_id"),
        F.when(internal, F.col("o_custkey") % 10 + INTERNAL_IDS)
        .otherwise(F.col("o_custkey") + 1)
        .alias("account_id"),
        day.alias("transaction_date"),
        F.date_add(day, (k % 4).cast("int")).alias("posting_date"),
        F.when(k % 7 == 0, k % 25)
        .when(internal, F.lit(0))
        .otherwise(F.col("c_nationkey"))
        .cast("long")
        .alias("branch_id"),
        kind.alias("transaction_type"),
        rules.signed_amount(kind, F.col("o_totalprice").cast(MONEY)).cast(MONEY).alias("amount"),
        ((kind == "fee") & (k % 5 == 1)).alias("fee_waived"),
        F.lit(False).alias("is_reversal"),
        _nullable("long").alias("reversal_of_transaction_id"),
    )
    t = F.col("transaction_id")
    back = F.date_add("transaction_date", (t % 5 + 1).cast("int"))
    reversals = originals.where((F.col("transaction_type") != "fee") & (t % 33 == 0) & (back <= as_of)).select(
        (t + REVERSAL_IDS).alias("transaction_id"),
        "account_id",
        back.alias("transaction_date"),
        F.date_add(back, (t % 4).cast("int")).alias("posting_date"),
        "branch_id",
        "transaction_type",
        (-F.col("amount")).cast(MONEY).alias("amount"),
        F.lit(False).alias("fee_waived"),
        F.lit(True).alias("is_reversal"),
        t.alias("reversal_of_transaction_id"),
    )
    return originals.unionByName(reversals)


def customers(customer: DataFrame, branch: DataFrame, active_ids: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    rows = customer.join(branch, F.col("c_nationkey") == F.col("branch_id")).select(
        k.alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("branch_id").alias("home_branch_id"),
        "region",
        _plus(FIRST_OPENING, k % 365).alias("signup_date"),
    )
    return rules.with_activity(rows, active_ids).select(*RAW["dim_customer"].names)


def daily_balances(account: DataFrame, start: Column, as_of: Column) -> DataFrame:
    """Daily rows of every open deposit account from ``start`` to the as-of date."""
    days = F.sequence(start, as_of, F.expr("interval 1 day"))
    d = F.col("balance_date")
    wave = (F.col("account_id") * 31 + F.dayofmonth(d) * 17 + F.month(d) * 101) % 9001
    held = account.where(F.col("product_id").isin(1, 2) & (F.col("status") == "open")).select("account_id")
    return (
        spread(held, "account_id")
        .select("account_id", days.alias("days"))
        .select("account_id", F.explode("days").alias("balance_date"))
        .select("account_id", "balance_date", (wave + 4850).cast(MONEY).alias("balance_amount"))
    )


def loan_months(account: DataFrame, product: DataFrame, as_of: Column) -> DataFrame:
    loans = account.join(product.where(F.col("product_type") == "loan").select("product_id", "product_name"), "product_id")
    end = rules.loan_end(F.col("write_off_flag"), F.col("write_off_date"), as_of)
    return rules.monthly_series(spread(loans, "account_id"), F.col("open_date"), end)


def loan_payments(account: DataFrame, product: DataFrame, as_of: Column) -> DataFrame:
    a, month = F.col("account_id"), F.month("month_start")
    late = F.when((a + month) % 13 == 0, 30).when((a + month) % 17 == 0, 60).otherwise(0)
    ramp = rules.days_past_due_before_write_off(F.col("month_start"), F.col("write_off_date"))
    return loan_months(account, product, as_of).select(
        a.alias("loan_account_id"),
        F.col("month_start").alias("payment_date"),
        ((a + month * 37) % 1600 + 200).cast(MONEY).alias("payment_amount"),
        F.when(F.col("write_off_flag"), ramp).otherwise(late).cast("int").alias("days_past_due"),
    )


def interest(account: DataFrame, product: DataFrame, balances: DataFrame, as_of: Column) -> DataFrame:
    a = F.col("account_id")
    origination = F.when(F.col("product_name") == "Personal Loan", a % 35001 + 5000).otherwise(a % 350001 + 150000)
    loans = loan_months(account, product, as_of).withColumn("origination", origination)
    return rules.deposit_interest(balances, account, product).unionByName(rules.loan_interest(loans))


def from_orders(
    spark: SparkSession,
    folder: str,
    as_of: date | None = None,
    calendar_start: date | None = None,
    balances_start: date | None = None,
) -> Tables:
    """The raw tables over a folder of ``nation region customer supplier orders`` parquet files.

    Every order is a transaction. Unless given, the as-of date is the day of the last order, the calendar starts
    with the first order or ``FIRST_OPENING``, whichever is earlier, and balances cover ``BALANCE_MONTHS`` months up to the
    as-of date. They are scalar subqueries over one column of the orders: nothing runs while tables are planned.
    """

    def read(t: Tables, name: str) -> DataFrame:
        return t.spark.read.parquet(f"{folder}/{name}.parquet")

    def ordered(t: Tables, aggregate) -> Column:
        return read(t, "orders").agg(aggregate("o_orderdate").cast("date").alias("day")).scalar()

    def last(t: Tables) -> Column:
        return F.lit(as_of) if as_of else ordered(t, F.max)

    def first(t: Tables) -> Column:
        return F.lit(calendar_start) if calendar_start else F.least(F.lit(FIRST_OPENING), ordered(t, F.min))

    def first_balance(t: Tables) -> Column:
        return F.lit(balances_start) if balances_start else F.add_months(month_start(last(t)), 1 - BALANCE_MONTHS)

    def calendar(t: Tables) -> DataFrame:
        bounds = t.spark.range(0, 1, 1, 1).select(first(t).alias("first"), last(t).alias("last"))
        return rules.calendar_between(bounds, "first", "last")

    return Tables(
        spark,
        {
            "dim_date": calendar,
            "dim_branch": lambda t: branches(read(t, "nation"), read(t, "region")),
            "dim_product": lambda t: products(t.spark),
            "dim_account": lambda t: accounts(read(t, "customer"), read(t, "supplier")),
            "dim_customer": lambda t: customers(
                read(t, "customer"),
                t.ref("dim_branch"),
                rules.active_customer_ids(t.ref("fact_transaction"), t.ref("dim_account"), last(t)),
            ),
            "fact_transaction": lambda t: transactions(read(t, "orders"), read(t, "customer"), last(t)),
            "fact_daily_balance": lambda t: daily_balances(t.ref("dim_account"), first_balance(t), last(t)),
            "fact_loan_payment": lambda t: loan_payments(t.ref("dim_account"), t.ref("dim_product"), last(t)),
            "fact_interest_monthly": lambda t: interest(
                t.ref("dim_account"), t.ref("dim_product"), t.ref("fact_daily_balance"), last(t)
            ),
        },
    )
