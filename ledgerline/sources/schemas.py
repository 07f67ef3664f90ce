"""Declared schemas of the nine raw tables, with their keys."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from ledgerline.functions.calendar import partition_of

MONEY = DecimalType(12, 2)

_LONG, _INT, _TEXT, _FLAG, _DAY = LongType(), IntegerType(), StringType(), BooleanType(), DateType()


def _struct(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


RAW: dict[str, StructType] = {
    "dim_date": _struct(
        date_key=_DAY, year=_INT, quarter=_INT, month=_INT, day=_INT,
        is_quarter_end=_FLAG, is_month_end=_FLAG,
    ),
    "dim_branch": _struct(branch_id=_LONG, branch_name=_TEXT, city=_TEXT, region=_TEXT),
    "dim_product": _struct(product_id=_LONG, product_name=_TEXT, product_type=_TEXT),
    "dim_customer": _struct(
        customer_id=_LONG, customer_name=_TEXT, home_branch_id=_LONG, region=_TEXT,
        is_active=_FLAG, signup_date=_DAY,
    ),
    "dim_account": _struct(
        account_id=_LONG, customer_id=_LONG, product_id=_LONG, home_branch_id=_LONG,
        open_date=_DAY, close_date=_DAY, status=_TEXT, is_internal=_FLAG,
        write_off_flag=_FLAG, write_off_date=_DAY,
    ),
    "fact_transaction": _struct(
        transaction_id=_LONG, account_id=_LONG, transaction_date=_DAY, posting_date=_DAY,
        branch_id=_LONG, transaction_type=_TEXT, amount=MONEY, fee_waived=_FLAG,
        is_reversal=_FLAG, reversal_of_transaction_id=_LONG,
    ),
    "fact_daily_balance": _struct(account_id=_LONG, balance_date=_DAY, balance_amount=MONEY),
    "fact_loan_payment": _struct(
        loan_account_id=_LONG, payment_date=_DAY, payment_amount=MONEY, days_past_due=_INT,
    ),
    "fact_interest_monthly": _struct(
        account_id=_LONG, month_start=_DAY, interest_income=MONEY, interest_expense=MONEY,
        outstanding_loan_balance=MONEY,
    ),
}

# Date column whose month splits a stored table into folders; other tables are stored whole.
STORED_BY = {
    "fact_transaction": "transaction_date",
    "fact_daily_balance": "balance_date",
    "fact_loan_payment": "payment_date",
    "fact_interest_monthly": "month_start",
    "fct_transactions": "transaction_date",
    "fct_account_balances_monthly": "month_start",
    "fct_loans_monthly": "month_start",
    "fct_interest_monthly": "month_start",
    "sketch_transacting_customers": "month_start",
    "sketch_transacting_accounts": "month_start",
    "sketch_loans": "month_start",
}

# Within a month, rows lie by this column, so a filtered key skips row groups and its runs compress.
CLUSTERED_BY = {
    "fct_transactions": "customer_id",
    "fct_account_balances_monthly": "customer_id",
    "fct_loans_monthly": "customer_id",
    "fct_interest_monthly": "customer_id",
}

PRIMARY_KEYS = {
    "dim_date": "date_key",
    "dim_branch": "branch_id",
    "dim_product": "product_id",
    "dim_customer": "customer_id",
    "dim_account": "account_id",
    "fact_transaction": "transaction_id",
}

# The product dimension of the bank.
PRODUCTS = [
    (1, "Chequing", "deposit"),
    (2, "Savings", "deposit"),
    (3, "Personal Loan", "loan"),
    (4, "Mortgage", "loan"),
    (5, "Credit Card", "credit"),
    (6, "Internal GL", "internal"),
]


def stored_schema(name: str, schema: StructType) -> StructType:
    """The schema a stored table is read with: its own columns and the month folder, if it has one."""
    day = STORED_BY.get(name)
    if day is None or day == "month_start":
        return schema
    return StructType([*schema.fields, StructField(partition_of(day), _DAY, True)])
