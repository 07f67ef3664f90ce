"""Business derivations of the warehouse, as column expressions and row generators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.calendar import calendar_columns, month_start, months_between_starts
from ledgerline.functions.numbers import clamp, rounded
from ledgerline.operators.joins import by_key
from ledgerline.sources.schemas import MONEY

# Monthly rates, loan terms and the delinquency ramp of the interest model.
DEPOSIT_MONTHLY_RATE = {"Chequing": "0.0002", "Savings": "0.0015"}
LOAN_TERM_MONTHS = {"Personal Loan": 60, "Mortgage": 300}
LOAN_MONTHLY_RATE = {"Personal Loan": "0.007", "Mortgage": "0.0035"}
DAYS_PAST_DUE_BEFORE_WRITE_OFF = [120, 90, 60, 30]
RAMP_MONTHS = 4
OUTFLOW_TYPES = ("withdrawal", "purchase", "fee")
ACTIVE_WINDOW_DAYS = 90

RATE = "decimal(6,4)"


def _by_product(product: Column, values: dict, kind: str) -> Column:
    chosen = None
    for name, value in values.items():
        literal = F.lit(value).cast(kind)
        chosen = F.when(product == name, literal) if chosen is None else chosen.when(product == name, literal)
    return chosen


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    days = spark.range(0, 1, 1, 1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("d")
    )
    return days.select(*calendar_columns(F.col("d")))


def calendar_between(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """A calendar spanning the dates of a one-row frame, e.g. a fact table's first and last day."""
    days = bounds.select(F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias("d"))
    return days.select(*calendar_columns(F.col("d")))


def effective_close(close_date: Column, as_of: date | Column) -> Column:
    return F.coalesce(close_date, F.lit(as_of))


def loan_end(write_off_flag: Column, write_off_date: Column, as_of: date | Column) -> Column:
    return F.when(write_off_flag, write_off_date).otherwise(F.lit(as_of))


def monthly_series(df: DataFrame, opened: Column, ended: Column) -> DataFrame:
    """One row per calendar month from the opening month to the end, with its index from zero."""
    spans = df.withColumns({"_first": month_start(opened), "_ended": ended}).where("_ended >= _first")
    months = F.sequence("_first", "_ended", F.expr("interval 1 month"))
    return spans.select(*df.columns, F.posexplode(months).alias("month_index", "month_start"))


def signed_amount(transaction_type: Column, amount: Column) -> Column:
    """Fees, withdrawals and purchases leave the account."""
    return F.when(transaction_type.isin(*OUTFLOW_TYPES), -F.abs(amount)).otherwise(F.abs(amount))


def days_past_due_before_write_off(month: Column, write_off_date: Column) -> Column:
    left = months_between_starts(month, write_off_date)
    ramp = F.array(*[F.lit(d) for d in DAYS_PAST_DUE_BEFORE_WRITE_OFF])
    step = clamp(left, low=F.lit(0), high=F.lit(len(DAYS_PAST_DUE_BEFORE_WRITE_OFF) - 1))
    return F.when(left <= RAMP_MONTHS, F.element_at(ramp, step + 1)).otherwise(F.lit(0))


def deposit_interest(balances: DataFrame, accounts: DataFrame, products: DataFrame) -> DataFrame:
    """Monthly expense of each deposit account: its mean daily balance times the product's rate."""
    monthly = balances.groupBy("account_id", month_start(F.col("balance_date")).alias("month_start")).agg(
        F.avg(F.col("balance_amount").cast("double")).cast("decimal(18,6)").alias("mean_balance")
    )
    product_of = accounts.select("account_id", "product_id").join(
        products.select("product_id", "product_name"), "product_id"
    )
    rate = F.coalesce(
        _by_product(F.col("product_name"), DEPOSIT_MONTHLY_RATE, RATE), F.lit("0").cast(RATE)
    )
    nothing = F.lit("0").cast(MONEY)
    return monthly.join(by_key(product_of), "account_id").select(
        "account_id",
        "month_start",
        nothing.alias("interest_income"),
        rounded(F.col("mean_balance") * rate).cast(MONEY).alias("interest_expense"),
        nothing.alias("outstanding_loan_balance"),
    )


def loan_interest(loan_months: DataFrame) -> DataFrame:
    """Straight-line outstanding balance and its monthly income.

    ``loan_months`` has account_id, month_start, month_index, product_name and origination.
    """
    term = _by_product(F.col("product_name"), LOAN_TERM_MONTHS, "int")
    rate = _by_product(F.col("product_name"), LOAN_MONTHLY_RATE, RATE)
    remaining = clamp(F.lit(1.0) - F.col("month_index") / term, low=F.lit(0.0))
    nothing = F.lit("0").cast(MONEY)
    return loan_months.withColumn(
        "outstanding", rounded(F.col("origination").cast("double") * remaining).cast(MONEY)
    ).select(
        "account_id",
        "month_start",
        rounded(F.col("outstanding") * rate).cast(MONEY).alias("interest_income"),
        nothing.alias("interest_expense"),
        F.col("outstanding").alias("outstanding_loan_balance"),
    )


def active_customer_ids(
    transactions: DataFrame, accounts: DataFrame, as_of: date | Column, window_days: int = ACTIVE_WINDOW_DAYS
) -> DataFrame:
    """Customers with a transaction on any account in the trailing window, once for each such account.

    Reversal rows count, the account's status does not matter and later dates are not cut off.
    Account ids are made distinct before they meet the accounts, so a busy account is one row.
    """
    recent = transactions.where(F.col("transaction_date") >= F.date_sub(F.lit(as_of), window_days))
    owners = accounts.where(F.col("customer_id").isNotNull()).select("account_id", "customer_id")
    return recent.select("account_id").distinct().join(by_key(owners), "account_id").select("customer_id")


def with_activity(customers: DataFrame, active_ids: DataFrame) -> DataFrame:
    """Whether EXISTS an active id that is the customer's: an existence join, which repeated ids cannot multiply."""
    ids = active_ids.select(F.col("customer_id").alias("_active_id"))
    # by its alias: a bare name would be looked up below ``ids`` first
    seen = ids.where(F.col("_active_id") == F.col("_customers.customer_id").outer()).exists()
    return customers.alias("_customers").withColumn("is_active", seen)
