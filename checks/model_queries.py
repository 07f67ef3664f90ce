"""Raw tables, staging, intermediate and mart models, and the business rules behind them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.oracle_tables import AS_OF
from checks.registry import register
from ledgerline import Tables
from ledgerline.operators import rules
from ledgerline.plans.models import netted_transactions
from ledgerline.functions.numbers import rounded
from ledgerline.plans.models import balance_by_product_month
from ledgerline.sources.projection import loan_months

MODEL_CASTS = {
    "stg_branches": {},
    "stg_customers": dict(dates="signup_date"),
    "stg_accounts": dict(dates="open_date, close_date, write_off_date"),
    "stg_daily_balances": dict(real="balance_amount", dates="balance_date"),
    "stg_loan_payments": dict(whole="days_past_due", real="payment_amount", dates="payment_date"),
    "stg_interest": dict(
        real="interest_income, interest_expense, outstanding_loan_balance", dates="month_start"
    ),
    "stg_transactions": dict(real="amount", dates="transaction_date, posting_date"),
    "int_account_balances_monthly": dict(real="month_end_balance", dates="month_start"),
    "int_loan_delinquency_monthly": dict(whole="days_past_due", dates="month_start"),
    "dim_customers": dict(dates="signup_date"),
    "fct_transactions": dict(real="amount", dates="transaction_date, posting_date"),
    "fct_account_balances_monthly": dict(real="month_end_balance", dates="month_start"),
    "fct_loans_monthly": dict(whole="days_past_due", dates="month_start"),
    "fct_interest_monthly": dict(
        real="interest_income, interest_expense, outstanding_loan_balance", dates="month_start"
    ),
}
RAW_OF = {
    "stg_branches": "dim_branch",
    "stg_customers": "dim_customer",
    "stg_accounts": "dim_account",
    "stg_daily_balances": "fact_daily_balance",
    "stg_loan_payments": "fact_loan_payment",
    "stg_interest": "fact_interest_monthly",
}


def _model(name: str):
    def run(t: Tables) -> DataFrame:
        df = t.ref(name)
        return df.withColumn("avg_daily_balance", F.round("avg_daily_balance", 6)) if "avg_daily_balance" in df.columns else df

    return run


for _name, _casts in MODEL_CASTS.items():
    _sql = f"SELECT * FROM {RAW_OF.get(_name, _name)}"
    if "balances_monthly" in _name:
        _sql = f"SELECT * REPLACE (round(avg_daily_balance, 6) AS avg_daily_balance) FROM {_name}"
    register(_name, _model(_name), _sql, **_casts)

register(
    "ledger_with_reversals",
    lambda t: t.ref("fact_transaction"),
    "SELECT * FROM fact_transaction",
    real="amount",
    dates="transaction_date, posting_date",
)


def products_in_use(t: Tables) -> DataFrame:
    held = t.ref("dim_account").groupBy("product_id").agg(F.count(F.lit(1)).alias("accounts"))
    return t.ref("stg_products").join(held, "product_id")


register(
    "stg_products_in_use",
    products_in_use,
    """SELECT p.product_id, p.product_name, p.product_type, count(*) AS accounts
       FROM dim_product p JOIN dim_account a ON a.product_id = p.product_id
       GROUP BY p.product_id, p.product_name, p.product_type""",
)


def calendar_of_ledger(t: Tables) -> DataFrame:
    """A calendar built from the ledger's own first and last posting, with each day's postings."""
    rows = t.ref("fact_transaction")
    span = rows.agg(F.min("posting_date").alias("first"), F.max("posting_date").alias("last"))
    posted = rows.groupBy(F.col("posting_date").alias("date_key")).agg(F.count(F.lit(1)).alias("postings"))
    days = rules.calendar_between(span, "first", "last")
    return days.join(posted, "date_key", "left").fillna(0, ["postings"])


register(
    "calendar_of_ledger",
    calendar_of_ledger,
    """SELECT d AS date_key, year(d) AS year, quarter(d) AS quarter, month(d) AS month, day(d) AS day,
              d = last_day(d) AND month(d) % 3 = 0 AS is_quarter_end, d = last_day(d) AS is_month_end,
              coalesce(n, 0) AS postings
       FROM (SELECT CAST(unnest(generate_series((SELECT min(posting_date) FROM fact_transaction),
                                                (SELECT max(posting_date) FROM fact_transaction), INTERVAL 1 DAY)) AS DATE) AS d)
       LEFT JOIN (SELECT posting_date, count(*) AS n FROM fact_transaction GROUP BY posting_date) p ON p.posting_date = d""",
    whole="year, quarter, month, day, postings",
    dates="date_key",
)


def postings_by_calendar(t: Tables) -> DataFrame:
    """The fixed calendar joined on the ledger date; postings past its end keep a NULL day."""
    days = t.ref("stg_dates").withColumnRenamed("date_key", "posting_date")
    posted = t.ref("fact_transaction").groupBy("posting_date").agg(F.count(F.lit(1)).alias("n"))
    return (
        posted.join(days, "posting_date", "left")
        .groupBy("year", "quarter", "is_month_end", "is_quarter_end")
        .agg(F.sum("n").alias("postings"))
    )


register(
    "stg_dates_by_posting_quarter",
    postings_by_calendar,
    """SELECT d.year, d.quarter, d.is_month_end, d.is_quarter_end, count(*) AS postings
       FROM fact_transaction t LEFT JOIN dim_date d ON t.posting_date = d.date_key
       GROUP BY d.year, d.quarter, d.is_month_end, d.is_quarter_end""",
    whole="year, quarter, postings",
)


def activity_flag(t: Tables) -> DataFrame:
    """The activity flag at another date and window than the stored one."""
    active = rules.active_customer_ids(t.ref("fact_transaction"), t.ref("dim_account"), date(2000, 6, 30), 30)
    flagged = rules.with_activity(t.ref("dim_customer").drop("is_active"), active)
    return flagged.select("customer_id", "region", "is_active")


register(
    "customer_activity_as_of",
    activity_flag,
    """SELECT c.customer_id, c.region,
              EXISTS (SELECT 1 FROM fact_transaction t JOIN dim_account a ON t.account_id = a.account_id
                      WHERE a.customer_id = c.customer_id AND t.transaction_date >= DATE '2000-05-31') AS is_active
       FROM dim_customer c""",
)


def as_of(t: Tables) -> Column:
    """The day the tables are as of: the last of the calendar."""
    return t.ref("dim_date").agg(F.max("date_key")).scalar()


def loan_schedule(t: Tables) -> DataFrame:
    """Month series of every loan with the delinquency ramp before a write-off."""
    months = loan_months(t.ref("dim_account"), t.ref("dim_product"), as_of(t))
    ramp = rules.days_past_due_before_write_off(F.col("month_start"), F.col("write_off_date"))
    return months.select("account_id", "product_name", "month_index", "month_start", F.when(F.col("write_off_flag"), ramp).alias("ramp_days"))


register(
    "loan_month_schedule",
    loan_schedule,
    """SELECT account_id, product_name, i AS month_index, month_start,
              CASE WHEN write_off_flag THEN
                   CASE (year(write_off_date) - year(month_start)) * 12 + month(write_off_date) - month(month_start)
                        WHEN 0 THEN 120 WHEN 1 THEN 90 WHEN 2 THEN 60 WHEN 3 THEN 30 WHEN 4 THEN 30 ELSE 0 END END AS ramp_days
       FROM loan_months""",
    whole="month_index, ramp_days",
    dates="month_start",
)


def account_life(t: Tables) -> DataFrame:
    a = t.ref("dim_account").withColumn("effective_close", rules.effective_close(F.col("close_date"), as_of(t)))
    end = F.when(F.col("write_off_flag"), F.col("write_off_date")).otherwise(F.col("effective_close"))
    return a.select("account_id", "effective_close", F.datediff(end, "open_date").alias("days_open"))


register(
    "account_effective_close",
    account_life,
    f"""SELECT account_id, coalesce(close_date, {AS_OF}) AS effective_close,
              date_diff('day', open_date, CASE WHEN write_off_flag THEN write_off_date ELSE coalesce(close_date, {AS_OF}) END) AS days_open
       FROM dim_account""",
    whole="days_open",
    dates="effective_close",
)

register(
    "deposit_interest_expense",
    lambda t: rules.deposit_interest(t.ref("fact_daily_balance"), t.ref("dim_account"), t.ref("dim_product")).select(
        "account_id", "month_start", "interest_expense"
    ),
    """SELECT account_id, month_start, interest_expense FROM fact_interest_monthly
       WHERE account_id IN (SELECT account_id FROM dim_account WHERE product_id IN (1, 2))""",
    real="interest_expense",
    dates="month_start",
)


def rounded_monthly_balance(t: Tables) -> DataFrame:
    return balance_by_product_month(t).withColumn("avg_balance", F.round("avg_balance", 4))


register(
    "monthly_balance_by_product",
    rounded_monthly_balance,
    """SELECT b.account_id, CAST(date_trunc('month', b.balance_date) AS DATE) AS month_start, p.product_name,
              round(avg(CAST(b.balance_amount AS DOUBLE)), 4) AS avg_balance
       FROM fact_daily_balance b JOIN dim_account a ON b.account_id = a.account_id
            JOIN dim_product p ON a.product_id = p.product_id
       GROUP BY b.account_id, date_trunc('month', b.balance_date), p.product_name""",
    dates="month_start",
)

register(
    "netted_ledger",
    lambda t: netted_transactions(t).select("transaction_id", "account_id", "transaction_date", "amount"),
    "SELECT transaction_id, account_id, transaction_date, amount FROM netted_ledger",
    real="amount",
    dates="transaction_date",
)


def eighths(t: Tables) -> DataFrame:
    """Amounts in eighths, many of them half a cent, rounded both ways."""
    eighth = F.col("payment_amount").cast("double") / 8
    return t.ref("fact_loan_payment").select(
        "loan_account_id", "payment_date",
        rounded(eighth.cast("decimal(18,3)"), 2).cast("double").alias("away_from_zero"),
        rounded(eighth.cast("decimal(18,3)"), 2, half_even=True).cast("double").alias("to_even"),
    )


register(
    "amounts_rounded_both_ways",
    eighths,
    """SELECT loan_account_id, payment_date, CAST(round(eighth, 2) AS DOUBLE) AS away_from_zero,
              CAST(round_even(eighth, 2) AS DOUBLE) AS to_even
       FROM (SELECT *, CAST(CAST(payment_amount AS DOUBLE) / 8 AS DECIMAL(18, 3)) AS eighth FROM fact_loan_payment)""",
    dates="payment_date",
)
