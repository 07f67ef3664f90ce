"""Staging, intermediate and mart models: each a function from tables to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.calendar import is_month_end, month_start
from ledgerline.operators.joins import by_key, lookup, status_code, status_value, without
from ledgerline.sources.schemas import RAW
from ledgerline.sources.tables import Loader, Tables

# staging model -> the raw table it passes through
PASS_THROUGH = {
    "stg_branches": "dim_branch",
    "stg_products": "dim_product",
    "stg_customers": "dim_customer",
    "stg_accounts": "dim_account",
    "stg_dates": "dim_date",
    "stg_daily_balances": "fact_daily_balance",
    "stg_loan_payments": "fact_loan_payment",
    "stg_interest": "fact_interest_monthly",
}

REVERSALS = "ledger_reversals"

GOVERNED_COLUMNS = [
    "transaction_id", "account_id", "transaction_date", "posting_date", "branch_id",
    "transaction_type", "amount", "fee_waived",
]


def _pass_through(raw: str) -> Loader:
    return lambda tables: tables.ref(raw).select(*RAW[raw].names)


def customer_accounts(tables: Tables) -> DataFrame:
    """The account columns governed models need, internal accounts left out."""
    return (
        tables.ref("dim_account")
        .where(~F.col("is_internal"))
        .select("account_id", "customer_id", "product_id", "home_branch_id")
    )


def reversed_ids(tables: Tables) -> DataFrame:
    """Ids that a reversal undoes. A catalog whose ledger holds some months only has the whole ledger's under ``REVERSALS``."""
    return tables.ref(REVERSALS if REVERSALS in tables.names() else "fact_transaction").select("reversal_of_transaction_id")


def netted_transactions(tables: Tables) -> DataFrame:
    """Both halves of every reversed pair removed; internal accounts still in."""
    originals = tables.ref("fact_transaction").where(~F.col("is_reversal"))
    return without(originals, reversed_ids(tables), "transaction_id", "reversal_of_transaction_id")


def governed_with_account(tables: Tables) -> DataFrame:
    """Governed transactions carrying their account's columns.

    One join both drops internal accounts and brings customer, product and home branch, so the fact
    mart does not visit the accounts twice.
    """
    return lookup(netted_transactions(tables), by_key(customer_accounts(tables)), "account_id")


def stg_transactions(tables: Tables) -> DataFrame:
    return governed_with_account(tables).select(*GOVERNED_COLUMNS)


def int_account_balances_monthly(tables: Tables) -> DataFrame:
    day, amount = F.col("balance_date"), F.col("balance_amount")
    return (
        tables.ref("stg_daily_balances")
        .groupBy("account_id", month_start(day).alias("month_start"))
        .agg(
            F.avg(amount.cast("double")).alias("avg_daily_balance"),
            F.max(F.when(is_month_end(day), amount)).alias("month_end_balance"),
        )
    )


def balance_by_product_month(tables: Tables) -> DataFrame:
    """Mean balance by account, month and product name."""
    product = tables.ref("stg_products").select("product_id", "product_name")
    product_of = tables.ref("stg_accounts").select("account_id", "product_id").join(product, "product_id")
    monthly = tables.ref("int_account_balances_monthly")
    return lookup(monthly, by_key(product_of.select("account_id", "product_name")), "account_id").select(
        "account_id", "month_start", "product_name", F.col("avg_daily_balance").alias("avg_balance")
    )


def int_loan_delinquency_monthly(tables: Tables) -> DataFrame:
    """Latest status of each loan in each month; of two payments on one day the later stage counts."""
    day = F.col("payment_date")
    latest = F.max(status_code(day, F.col("days_past_due"))).alias("latest")
    return (
        tables.ref("stg_loan_payments")
        .groupBy("loan_account_id", month_start(day).alias("month_start"))
        .agg(latest)
        .select("loan_account_id", "month_start", status_value(F.col("latest")).alias("days_past_due"))
    )


def dim_customers(tables: Tables) -> DataFrame:
    customer = tables.ref("stg_customers").drop("region")
    branch = tables.ref("stg_branches").select(
        F.col("branch_id").alias("home_branch_id"), F.col("branch_name").alias("home_branch_name"), "region"
    )
    return lookup(customer, branch, "home_branch_id").select(
        "customer_id", "customer_name", "is_active", "signup_date", "home_branch_id", "home_branch_name", "region"
    )


def branch_role(tables: Tables, role: str, key: str) -> DataFrame:
    """The branch dimension under a role's name, keyed by the fact's own branch column."""
    return tables.ref("stg_branches").select(
        F.col("branch_id").alias(key),
        F.col("branch_name").alias(f"{role}_branch_name"),
        F.col("region").alias(f"{role}_region"),
    )


def fct_transactions(tables: Tables) -> DataFrame:
    rows = governed_with_account(tables).withColumnRenamed("branch_id", "transaction_branch_id")
    for role in ("transaction", "home"):
        key = f"{role}_branch_id"
        rows = lookup(rows, branch_role(tables, role, key), key)
    return rows.select(
        "transaction_id", "account_id", "customer_id", "product_id", "transaction_date", "posting_date",
        "transaction_type", "amount", "fee_waived", "transaction_branch_id", "transaction_branch_name",
        "transaction_region", "home_branch_id", "home_branch_name", "home_region",
    )


def _account_owner(tables: Tables, *more: str) -> DataFrame:
    return tables.ref("stg_accounts").select("account_id", "customer_id", "product_id", *more)


def fct_account_balances_monthly(tables: Tables) -> DataFrame:
    monthly = tables.ref("int_account_balances_monthly")
    return monthly.join(by_key(_account_owner(tables)), "account_id").select(
        "account_id", "customer_id", "product_id", "month_start", "avg_daily_balance", "month_end_balance"
    )


def fct_loans_monthly(tables: Tables) -> DataFrame:
    owner = _account_owner(tables, "write_off_flag").withColumnRenamed("account_id", "loan_account_id")
    return tables.ref("int_loan_delinquency_monthly").join(by_key(owner), "loan_account_id").select(
        "loan_account_id", "month_start", "days_past_due", "customer_id", "product_id", "write_off_flag"
    )


def fct_interest_monthly(tables: Tables) -> DataFrame:
    rows = lookup(tables.ref("stg_interest"), by_key(_account_owner(tables)), "account_id")
    return rows.select(
        "account_id", "month_start", "interest_income", "interest_expense", "outstanding_loan_balance",
        "customer_id", "product_id",
    )


STAGING: dict[str, Loader] = {
    **{name: _pass_through(raw) for name, raw in PASS_THROUGH.items()},
    "stg_transactions": stg_transactions,
}
INTERMEDIATE: dict[str, Loader] = {
    "int_account_balances_monthly": int_account_balances_monthly,
    "int_loan_delinquency_monthly": int_loan_delinquency_monthly,
}
# what tells the rows of a mart apart; checked when a mart is written
GRAINS = {
    "dim_customers": ("customer_id",),
    "fct_transactions": ("transaction_id",),
    "fct_account_balances_monthly": ("account_id", "month_start"),
    "fct_loans_monthly": ("loan_account_id", "month_start"),
    "fct_interest_monthly": ("account_id", "month_start"),
}
MARTS: dict[str, Loader] = {
    "dim_customers": dim_customers,
    "fct_transactions": fct_transactions,
    "fct_account_balances_monthly": fct_account_balances_monthly,
    "fct_loans_monthly": fct_loans_monthly,
    "fct_interest_monthly": fct_interest_monthly,
}


def with_models(raw: Tables) -> Tables:
    """The raw tables with every governed model on top."""
    return raw.extend({**STAGING, **INTERMEDIATE, **MARTS})


def marts(tables: Tables) -> Tables:
    """Only what consumers may query: the five marts and the calendar."""
    return tables.only({**{name: name for name in MARTS}, "dim_dates": "stg_dates"})
