"""The reference questions: parameterised templates, each usable for one period or grouped.

Raw readings work on the ledger as booked, governed readings net reversed pairs and leave internal
accounts out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.calendar import Period, month_start, period_start_sql, within
from ledgerline.functions.numbers import percent
from ledgerline.operators.joins import status_code, status_value, sums_through_key, without
from ledgerline.plans.models import customer_accounts, netted_transactions, reversed_ids
from ledgerline.sources.tables import Tables

PERIOD = "period"


def _grouping(grain: str | None, day: str) -> list[Column]:
    return [F.expr(period_start_sql(grain, day)).alias(PERIOD)] if grain else []


def _closed(first: date | None, last: date | None) -> Period | None:
    return Period(first, last + timedelta(days=1)) if first and last else None


def _fees(tables: Tables, net: bool, period: Period | None) -> DataFrame:
    fees = tables.ref("fact_transaction").where((F.col("transaction_type") == "fee") & ~F.col("is_reversal"))
    return within(fees.where(~F.col("fee_waived")) if net else fees, period, "transaction_date")


def fee_revenue(tables: Tables, net: bool = True, grain: str | None = None, period: Period | None = None) -> DataFrame:
    """Fees as booked, internal accounts included; net leaves waived fees out."""
    return _fees(tables, net, period).groupBy(*_grouping(grain, "transaction_date")).agg(
        (-F.sum("amount")).alias("fee_revenue")
    )


def net_fee_revenue_by_product(
    tables: Tables, products: Sequence[str] | None = None, grain: str | None = None, period: Period | None = None
) -> DataFrame:
    product = tables.ref("dim_product").select("product_id", "product_name")
    if products:
        product = product.where(F.col("product_name").isin(*products))
    account = tables.ref("dim_account").select("account_id", "product_id").join(product, "product_id")
    by = _grouping(grain, "transaction_date")
    revenue = [(-F.sum("amount")).alias("fee_revenue")]
    return sums_through_key(_fees(tables, True, period), account, "account_id", by, revenue, ["product_name"])


def transaction_count(
    tables: Tables,
    day: str = "transaction_date",
    grain: str | None = None,
    period: Period | None = None,
    internal: bool = False,
) -> DataFrame:
    """Every booked row counts, reversals too; ``day`` chooses the customer's or the ledger's date."""
    rows = within(tables.ref("fact_transaction"), period, day)
    by, n = _grouping(grain, day), F.count(F.lit(1)).alias("transactions")
    if internal:
        return rows.groupBy(*by).agg(n)
    accounts = customer_accounts(tables).select("account_id")
    return sums_through_key(rows, accounts, "account_id", by, [n])


def naive_volume(tables: Tables, grain: str | None = None, period: Period | None = None) -> DataFrame:
    rows = within(tables.ref("fact_transaction"), period, "transaction_date")
    return rows.groupBy(*_grouping(grain, "transaction_date")).agg(F.sum(F.abs("amount")).alias("volume"))


def netted_volume(tables: Tables, grain: str | None = None, period: Period | None = None) -> DataFrame:
    """Net of reversed pairs, internal accounts included."""
    rows = within(netted_transactions(tables), period, "transaction_date")
    return rows.groupBy(*_grouping(grain, "transaction_date")).agg(F.sum(F.abs("amount")).alias("volume"))


def governed_volume(
    tables: Tables, day: str = "transaction_date", grain: str | None = None, period: Period | None = None
) -> DataFrame:
    rows = within(netted_transactions(tables), period, day)
    volume = [F.sum(F.abs("amount")).alias("volume")]
    accounts = customer_accounts(tables).select("account_id")
    return sums_through_key(rows, accounts, "account_id", _grouping(grain, day), volume)


def governed_volume_by_home_branch(
    tables: Tables, grain: str | None = None, period: Period | None = None, branch: str | None = None
) -> DataFrame:
    rows = within(netted_transactions(tables), period, "transaction_date")
    home = tables.ref("dim_branch").select(
        F.col("branch_id").alias("home_branch_id"), F.col("branch_name").alias("home_branch_name")
    )
    if branch:
        home = home.where(F.col("home_branch_name") == branch)
    accounts = customer_accounts(tables).select("account_id", "home_branch_id").join(home, "home_branch_id")
    volume = [F.sum(F.abs("amount")).alias("volume")]
    return sums_through_key(
        rows, accounts, "account_id", _grouping(grain, "transaction_date"), volume, ["home_branch_name"]
    )


def count_at_transaction_branch(
    tables: Tables, grain: str | None = None, period: Period | None = None, branch: str | None = None
) -> DataFrame:
    """Transactions by the branch they happened at, whatever the customer's home branch."""
    rows = within(tables.ref("fact_transaction"), period, "transaction_date")
    here = tables.ref("dim_branch").select("branch_id", F.col("branch_name").alias("transaction_branch_name"))
    if branch:
        here = here.where(F.col("transaction_branch_name") == branch)
    accounts = customer_accounts(tables).select("account_id")
    per_branch = sums_through_key(
        rows,
        accounts,
        "account_id",
        [F.col("branch_id"), *_grouping(grain, "transaction_date")],
        [F.count(F.lit(1)).alias("transactions")],
    )
    return per_branch.join(here, "branch_id").drop("branch_id")


def count_at_branch(tables: Tables, branch: str, period: Period | None = None) -> DataFrame:
    """One number: customers' transactions at a branch, 0 if there were none."""
    return count_at_transaction_branch(tables, None, period, branch).agg(
        F.coalesce(F.sum("transactions"), F.lit(0).cast("long")).alias("transactions")
    )


def reversed_originals(tables: Tables, grain: str | None = None, period: Period | None = None) -> DataFrame:
    """Transactions later reversed, by the original's own date; their id tells them apart."""
    reversals = (
        reversed_ids(tables)
        .where(F.col("reversal_of_transaction_id").isNotNull())
        .select(F.col("reversal_of_transaction_id").alias("transaction_id"))
        .distinct()
    )
    originals = within(tables.ref("fact_transaction"), period, "transaction_date")
    return (
        originals.select("transaction_id", "transaction_date")
        .join(reversals, "transaction_id", "left_semi")
        .groupBy(*_grouping(grain, "transaction_date"))
        .agg(F.count(F.lit(1)).alias("reversed_transactions"))  # the semi join keeps a transaction once
    )


def active_customers(tables: Tables, by: Sequence[str] = ("region",)) -> DataFrame:
    return tables.ref("dim_customer").where(F.col("is_active")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("active_customers")
    )


def _open_account_owners(tables: Tables) -> DataFrame:
    accounts = tables.ref("dim_account")
    return accounts.where((F.col("status") == "open") & F.col("customer_id").isNotNull()).select("customer_id").distinct()


def customers_with_open_account(tables: Tables, by: Sequence[str] = ("region",)) -> DataFrame:
    customers = tables.ref("dim_customer").join(_open_account_owners(tables), "customer_id", "left_semi")
    return customers.groupBy(*by).agg(F.count_distinct("customer_id").alias("customers"))


def average_daily_balance(tables: Tables, grain: str | None = None, first: date | None = None, last: date | None = None) -> DataFrame:
    """Mean over every daily row of a closed date range."""
    rows = within(tables.ref("fact_daily_balance"), _closed(first, last), "balance_date")
    return rows.groupBy(*_grouping(grain, "balance_date")).agg(
        F.avg(F.col("balance_amount").cast("double")).alias("average_daily_balance")
    )


def total_balance(tables: Tables, on: date | None = None) -> DataFrame:
    rows = within(tables.ref("fact_daily_balance"), _closed(on, on), "balance_date")
    return rows.groupBy("balance_date").agg(F.sum("balance_amount").alias("total_balance"))


def loan_status_as_of(tables: Tables, dates: Sequence[date]) -> DataFrame:
    """Latest status of every active loan as of each date, one pass for all the dates.

    One row per loan and date on which the loan already had a payment.
    """
    day, code = F.col("payment_date"), status_code(F.col("payment_date"), F.col("days_past_due"))
    latest = (
        tables.ref("fact_loan_payment")
        .where(day <= F.lit(max(dates)))
        .groupBy("loan_account_id")
        .agg(*[F.max(F.when(day <= F.lit(d), code)).alias(f"_{i}") for i, d in enumerate(dates)])
    )
    book = (
        tables.ref("dim_account")
        .where(~F.col("write_off_flag"))
        .select(F.col("account_id").alias("loan_account_id"), "product_id")
    )
    points = F.array(*[F.struct(F.lit(d).alias("as_of"), F.col(f"_{i}").alias("code")) for i, d in enumerate(dates)])
    return (
        latest.join(book, "loan_account_id")
        .select("loan_account_id", "product_id", F.inline(points))
        .where(F.col("code").isNotNull())
        .select("loan_account_id", "product_id", "as_of", status_value(F.col("code")).alias("days_past_due"))
    )


def delinquency_as_of(tables: Tables, dates: Sequence[date], days: int = 30, by: Sequence[str] = ()) -> DataFrame:
    late = F.count(F.when(F.col("days_past_due") >= days, 1))
    return loan_status_as_of(tables, dates).groupBy("as_of", *by).agg(
        F.count(F.lit(1)).alias("active_loans"),
        late.alias("delinquent_loans"),
        percent(late, F.count(F.lit(1))).alias("delinquency_rate"),
    )


def written_off_loans(tables: Tables) -> DataFrame:
    loans = tables.ref("dim_product").where(F.col("product_type") == "loan").select("product_id", "product_name")
    return (
        tables.ref("dim_account")
        .where(F.col("write_off_flag"))
        .join(loans, "product_id")
        .groupBy("product_name")
        .agg(F.count(F.lit(1)).alias("written_off_loans"))
    )


def average_balance_of_active(
    tables: Tables, first: date, last: date, by: Sequence[str] = ("region", "product_name")
) -> DataFrame:
    """Mean daily balance of active customers by region and product in a date range.

    Balances, by far the largest table, are reduced to one row per account before any join.
    """
    per_account = (
        within(tables.ref("fact_daily_balance"), _closed(first, last), "balance_date")
        .groupBy("account_id")
        .agg(F.sum("balance_amount").alias("total"), F.count("balance_amount").alias("days"))
    )
    active = tables.ref("dim_customer").where(F.col("is_active")).select("customer_id", "region")
    product = tables.ref("dim_product").select("product_id", "product_name")
    owned = tables.ref("dim_account").select("account_id", "customer_id", "product_id").join(product, "product_id")
    return (
        per_account.join(owned, "account_id")
        .join(active, "customer_id")
        .groupBy(*by)
        .agg((F.sum("total").cast("double") / F.sum("days")).alias("average_daily_balance"))
    )


# ------------------------------------------------------------------ golden answers in few passes


@dataclass(frozen=True)
class Question:
    id: str
    tag: str
    source: str        # the prepared frame the answer is an aggregate of
    answer: str        # SQL aggregate over that frame
    text: str = ""     # the question as it is asked
    sql: str = ""      # one statement over the raw tables that answers it on its own
    answerable: bool = True


def ledger(tables: Tables) -> DataFrame:
    """The ledger summed by account, branch, month and status, next to its account and branches."""
    t = tables.ref("fact_transaction")
    reversed_once = (
        reversed_ids(tables)
        .where(F.col("reversal_of_transaction_id").isNotNull())
        .select(F.col("reversal_of_transaction_id").alias("transaction_id"))
        .distinct()
        .withColumn("_reversed", F.lit(True))
    )
    sums = (
        t.join(reversed_once, "transaction_id", "left")
        .withColumn("is_reversed", F.coalesce("_reversed", F.lit(False)))
        .groupBy(
            "account_id", "branch_id", "transaction_type", "fee_waived", "is_reversal", "is_reversed",
            month_start(F.col("transaction_date")).alias("transaction_month"),
            month_start(F.col("posting_date")).alias("posting_month"),
        )
        .agg(
            F.sum("amount").alias("amount"),
            F.sum(F.abs("amount")).alias("volume"),
            F.count(F.lit(1)).alias("transactions"),
            F.count(F.when(F.col("is_reversed"), 1)).alias("reversed_rows"),
        )
    )
    account = tables.ref("dim_account").select("account_id", "product_id", "home_branch_id", "is_internal")
    product = tables.ref("dim_product").select("product_id", "product_name")
    branch = tables.ref("dim_branch")
    home = branch.select(F.col("branch_id").alias("home_branch_id"), F.col("branch_name").alias("home_branch_name"))
    here = branch.select("branch_id", F.col("branch_name").alias("transaction_branch_name"))
    return (
        sums.join(account, "account_id", "left")
        .join(product, "product_id", "left")
        .join(home, "home_branch_id", "left")
        .join(here, "branch_id", "left")
    )


def customer_standing(tables: Tables) -> DataFrame:
    owners = _open_account_owners(tables).withColumn("_open", F.lit(True))
    return (
        tables.ref("dim_customer")
        .join(owners, "customer_id", "left")
        .select("customer_id", "region", "is_active", F.coalesce("_open", F.lit(False)).alias("has_open_account"))
    )


def account_products(tables: Tables) -> DataFrame:
    product = tables.ref("dim_product").select("product_id", "product_type")
    return tables.ref("dim_account").select("product_id", "write_off_flag").join(product, "product_id")


def answers(tables: Tables, questions: Sequence[Question], as_of: Sequence[date]) -> DataFrame:
    """One row per answerable question. All questions over the same frame share a single pass."""
    frames = {
        "ledger": lambda: ledger(tables),
        "balances": lambda: tables.ref("fact_daily_balance"),
        "loans": lambda: loan_status_as_of(tables, as_of),
        "customers": lambda: customer_standing(tables),
        "accounts": lambda: account_products(tables),
    }
    result = None
    for source, load in frames.items():
        asked = [q for q in questions if q.answerable and q.source == source]
        if not asked:
            continue
        row = load().selectExpr(*[f"round(CAST({q.answer} AS double), 2) AS `{q.id}`" for q in asked])
        part = row.unpivot([], [f"`{q.id}`" for q in asked], "question_id", "expected_result")
        result = part if result is None else result.union(part)
    return result


# the reading each ambiguity is settled by unless a question asks for the other one
READING = {
    "gross_vs_net_revenue": "Net revenue leaves waived fees out; gross keeps them.",
    "posting_vs_transaction_date": "Customer activity goes by transaction date, the ledger by posting date.",
    "open_vs_active_account": "Active means a transaction in the trailing window; open means an open account.",
    "month_end_vs_avg_daily_balance": "An average is over every day; a month end is one day's snapshot.",
    "written_off_loans": "Delinquency is measured on the active book; write-offs have their own count.",
    "reversed_transactions": "Volume leaves both halves of a reversed pair out.",
    "internal_accounts": "Customer figures leave the bank's own accounts out.",
    "customer_vs_branch_location": "Branch performance goes by home branch, foot traffic by the transaction's branch.",
}


def question_records(tables: Tables, questions: Sequence[Question], as_of: Sequence[date]) -> DataFrame:
    """The question set with each answerable question's expected result, computed from the tables."""
    schema = "id string, question string, answerable boolean, ambiguity_tag string, sql string, business_definition string"
    rows = [(q.id, q.text, q.answerable, q.tag or None, q.sql or None, READING.get(q.tag)) for q in questions]
    expected = answers(tables, questions, as_of).withColumnRenamed("question_id", "id")
    return tables.spark.createDataFrame(rows, schema).join(expected, "id", "left").select(
        "id", "question", "answerable", "ambiguity_tag", "sql", "expected_result", "business_definition"
    )
