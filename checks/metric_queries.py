"""Named metrics by dimension and period, and the report measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import register
from ledgerline import Tables
from ledgerline.plans import metrics as m
from ledgerline.plans.models import marts
from ledgerline.plans.report_measures import evaluate

VOLUME = "sum(abs(amount))"
FEES_NET = "sum(CASE WHEN transaction_type = 'fee' AND fee_waived = FALSE THEN -amount ELSE 0 END)"
FEES_GROSS = "sum(CASE WHEN transaction_type = 'fee' THEN -amount ELSE 0 END)"
ACTIVE = "count(DISTINCT CASE WHEN is_active THEN customer_id END)"
INACTIVE = "count(DISTINCT CASE WHEN NOT is_active THEN customer_id END)"
CUSTOMERS = "count(DISTINCT customer_id)"
NII = "sum(interest_income) - sum(interest_expense)"
LOANS = "count(DISTINCT loan_account_id)"
ACTIVE_LOANS = "count(DISTINCT CASE WHEN NOT write_off_flag THEN loan_account_id END)"
LATE30 = "sum(CASE WHEN NOT write_off_flag AND days_past_due >= 30 THEN 1 ELSE 0 END)"
LATE90 = "sum(CASE WHEN NOT write_off_flag AND days_past_due >= 90 THEN 1 ELSE 0 END)"
LOST = "sum(CASE WHEN write_off_flag THEN 1 ELSE 0 END)"


def share(a: str, b: str, digits: int = 6) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {digits})"


def ask(*args, digits: int = 6, **kwargs):
    """A metric query with its real-valued columns rounded, as sums of doubles depend on order."""

    def run(t: Tables) -> DataFrame:
        df = m.query(marts(t), *args, **kwargs)
        reals = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
        return df.withColumns({c: F.round(c, digits) for c in reals})

    return run


TRANSACTION_METRICS = ["transaction_volume", "fee_revenue_net", "fee_revenue_gross", "transaction_count"]
TRANSACTION_SQL = (
    f"{VOLUME} AS transaction_volume, {FEES_NET} AS fee_revenue_net, {FEES_GROSS} AS fee_revenue_gross, "
    "count(*) AS transaction_count"
)
TRANSACTION_REAL = "transaction_volume, fee_revenue_net, fee_revenue_gross"

register(
    "metric_transactions_total",
    ask(TRANSACTION_METRICS),
    f"SELECT {TRANSACTION_SQL} FROM fct_transactions",
    real=TRANSACTION_REAL,
    whole="transaction_count",
)
for _dim in ("home_branch_name", "transaction_branch_name", "transaction_type", "fee_waived"):
    register(
        f"metric_transactions_by_{_dim}",
        ask(TRANSACTION_METRICS, by=[_dim]),
        f"SELECT {_dim}, {TRANSACTION_SQL} FROM fct_transactions GROUP BY {_dim}",
        real=TRANSACTION_REAL,
        whole="transaction_count",
    )
for _grain in ("day", "month", "quarter", "year"):
    register(
        f"metric_transactions_by_{_grain}",
        ask(TRANSACTION_METRICS, grain=_grain),
        f"SELECT CAST(date_trunc('{_grain}', transaction_date) AS DATE) AS period, {TRANSACTION_SQL} FROM fct_transactions GROUP BY 1",
        real=TRANSACTION_REAL,
        whole="transaction_count",
        dates="period",
    )
register(
    "metric_transactions_by_posting_quarter",
    ask(TRANSACTION_METRICS, grain="quarter", time="posting_date"),
    f"SELECT CAST(date_trunc('quarter', posting_date) AS DATE) AS period, {TRANSACTION_SQL} FROM fct_transactions GROUP BY 1",
    real=TRANSACTION_REAL,
    whole="transaction_count",
    dates="period",
)
register(
    "metric_transactions_by_customer_region_and_quarter",
    ask(TRANSACTION_METRICS, by=["customer__region"], grain="quarter"),
    f"""SELECT c.region AS customer__region, CAST(date_trunc('quarter', transaction_date) AS DATE) AS period, {TRANSACTION_SQL}
        FROM fct_transactions t LEFT JOIN dim_customers c ON t.customer_id = c.customer_id GROUP BY 1, 2""",
    real=TRANSACTION_REAL,
    whole="transaction_count",
    dates="period",
)
register(
    "metric_transactions_by_calendar_year_of_posting",
    ask(TRANSACTION_METRICS, by=["date__year", "date__quarter"], time="posting_date"),
    f"""SELECT d.year AS date__year, d.quarter AS date__quarter, {TRANSACTION_SQL}
        FROM fct_transactions t LEFT JOIN dim_date d ON t.posting_date = d.date_key GROUP BY 1, 2""",
    real=TRANSACTION_REAL,
    whole="transaction_count, date__year, date__quarter",
)
register(
    "metric_transactions_filtered",
    ask(
        TRANSACTION_METRICS,
        by=["home_branch_name"],
        where={
            "customer__region": lambda c: c.isin("ASIA", "EUROPE"),
            "customer__is_active": lambda c: c,
            "date__year": lambda c: c == 2000,
        },
    ),
    f"""SELECT t.home_branch_name, {TRANSACTION_SQL}
        FROM fct_transactions t JOIN dim_customers c ON t.customer_id = c.customer_id
             JOIN dim_date d ON t.transaction_date = d.date_key
        WHERE c.region IN ('ASIA', 'EUROPE') AND c.is_active AND d.year = 2000 GROUP BY 1""",
    real=TRANSACTION_REAL,
    whole="transaction_count",
)

CUSTOMER_METRICS = ["customer_count", "active_customer_count", "inactive_customer_count", "customer_inactivity_rate"]
CUSTOMER_SQL = (
    f"{CUSTOMERS} AS customer_count, {ACTIVE} AS active_customer_count, {INACTIVE} AS inactive_customer_count, "
    f"{share(INACTIVE, CUSTOMERS)} AS customer_inactivity_rate"
)
register("metric_customers_total", ask(CUSTOMER_METRICS), f"SELECT {CUSTOMER_SQL} FROM dim_customers")
for _dim in ("region", "home_branch_name", "is_active"):
    register(
        f"metric_customers_by_{_dim}",
        ask(CUSTOMER_METRICS, by=[_dim]),
        f"SELECT {_dim}, {CUSTOMER_SQL} FROM dim_customers GROUP BY {_dim}",
    )
register(
    "metric_customers_by_signup_month",
    ask(CUSTOMER_METRICS, grain="month"),
    f"SELECT CAST(date_trunc('month', signup_date) AS DATE) AS period, {CUSTOMER_SQL} FROM dim_customers GROUP BY 1",
    dates="period",
)

BALANCE_METRICS = ["average_daily_balance", "month_end_balance"]
BALANCE_SQL = (
    "round(avg(avg_daily_balance), 4) AS average_daily_balance, "
    "round(avg(CAST(month_end_balance AS DOUBLE)), 4) AS month_end_balance"
)
register("metric_balances_total", ask(BALANCE_METRICS, digits=4), f"SELECT {BALANCE_SQL} FROM fct_account_balances_monthly")
register(
    "metric_balances_by_month",
    ask(BALANCE_METRICS, grain="month", digits=4),
    f"SELECT month_start AS period, {BALANCE_SQL} FROM fct_account_balances_monthly GROUP BY 1",
    dates="period",
)
register(
    "metric_balances_by_customer_branch_and_quarter",
    ask(BALANCE_METRICS, by=["customer__home_branch_name"], grain="quarter", digits=4),
    f"""SELECT c.home_branch_name AS customer__home_branch_name, CAST(date_trunc('quarter', month_start) AS DATE) AS period, {BALANCE_SQL}
        FROM fct_account_balances_monthly b LEFT JOIN dim_customers c ON b.customer_id = c.customer_id GROUP BY 1, 2""",
    dates="period",
)

INTEREST_METRICS = [
    "gross_interest_income", "gross_interest_expense", "net_interest_income", "total_outstanding_loan_balance",
    "net_interest_margin",
]
INTEREST_SQL = (
    "sum(interest_income) AS gross_interest_income, sum(interest_expense) AS gross_interest_expense, "
    f"{NII} AS net_interest_income, sum(outstanding_loan_balance) AS total_outstanding_loan_balance, "
    f"{share(NII, 'sum(outstanding_loan_balance)', 8)} AS net_interest_margin"
)
INTEREST_REAL = "gross_interest_income, gross_interest_expense, net_interest_income, total_outstanding_loan_balance"
register("metric_interest_total", ask(INTEREST_METRICS, digits=8), f"SELECT {INTEREST_SQL} FROM fct_interest_monthly", real=INTEREST_REAL)
register(
    "metric_interest_by_month",
    ask(INTEREST_METRICS, grain="month", digits=8),
    f"SELECT month_start AS period, {INTEREST_SQL} FROM fct_interest_monthly GROUP BY 1",
    real=INTEREST_REAL,
    dates="period",
)
register(
    "metric_interest_by_customer_region",
    ask(INTEREST_METRICS, by=["customer__region"], digits=8),
    f"""SELECT c.region AS customer__region, {INTEREST_SQL}
        FROM fct_interest_monthly i LEFT JOIN dim_customers c ON i.customer_id = c.customer_id GROUP BY 1""",
    real=INTEREST_REAL,
)

LOAN_METRICS = [
    "active_loan_count", "total_loan_count", "delinquent_30d_count", "delinquency_rate_30d", "delinquent_90d_count",
    "delinquency_rate_90d", "charge_off_count", "charge_off_rate", "delinquency_rate_30d_by_month_rows",
    "delinquency_rate_90d_by_month_rows", "charge_off_rate_by_month_rows",
]
ACTIVE_ROWS = "sum(CASE WHEN NOT write_off_flag THEN 1 ELSE 0 END)"
LOAN_SQL = (
    f"{ACTIVE_LOANS} AS active_loan_count, {LOANS} AS total_loan_count, {LATE30} AS delinquent_30d_count, "
    f"{share(LATE30, ACTIVE_LOANS)} AS delinquency_rate_30d, {LATE90} AS delinquent_90d_count, "
    f"{share(LATE90, ACTIVE_LOANS)} AS delinquency_rate_90d, {LOST} AS charge_off_count, "
    f"{share(LOST, LOANS)} AS charge_off_rate, {share(LATE30, ACTIVE_ROWS)} AS delinquency_rate_30d_by_month_rows, "
    f"{share(LATE90, ACTIVE_ROWS)} AS delinquency_rate_90d_by_month_rows, {share(LOST, 'count(*)')} AS charge_off_rate_by_month_rows"
)
LOAN_WHOLE = "active_loan_count, total_loan_count, delinquent_30d_count, delinquent_90d_count, charge_off_count"
register("metric_loans_total", ask(LOAN_METRICS), f"SELECT {LOAN_SQL} FROM fct_loans_monthly", whole=LOAN_WHOLE)
register(
    "metric_loans_by_month",
    ask(LOAN_METRICS, grain="month"),
    f"SELECT month_start AS period, {LOAN_SQL} FROM fct_loans_monthly GROUP BY 1",
    whole=LOAN_WHOLE,
    dates="period",
)
register(
    "metric_loans_by_write_off_flag",
    ask(LOAN_METRICS, by=["write_off_flag"]),
    f"SELECT write_off_flag, {LOAN_SQL} FROM fct_loans_monthly GROUP BY 1",
    whole=LOAN_WHOLE,
)
register(
    "metric_loans_by_customer_region",
    ask(LOAN_METRICS, by=["customer__region"]),
    f"""SELECT c.region AS customer__region, {LOAN_SQL}
        FROM fct_loans_monthly l LEFT JOIN dim_customers c ON l.customer_id = c.customer_id GROUP BY 1""",
    whole=LOAN_WHOLE,
)

# several models side by side
ACROSS = ["transaction_volume", "net_interest_income", "delinquency_rate_30d", "average_daily_balance"]
register(
    "metric_across_models_by_region_and_month",
    ask(ACROSS, by=["customer__region"], grain="month", digits=4),
    f"""SELECT region AS customer__region, period, max(v) AS transaction_volume, max(n) AS net_interest_income,
               round(max(d), 4) AS delinquency_rate_30d, round(max(b), 4) AS average_daily_balance
        FROM (
          SELECT c.region, CAST(date_trunc('month', transaction_date) AS DATE) AS period, {VOLUME} AS v, NULL AS n, NULL AS d, NULL AS b
          FROM fct_transactions t LEFT JOIN dim_customers c ON t.customer_id = c.customer_id GROUP BY 1, 2
          UNION ALL
          SELECT c.region, month_start, NULL, {NII}, NULL, NULL
          FROM fct_interest_monthly t LEFT JOIN dim_customers c ON t.customer_id = c.customer_id GROUP BY 1, 2
          UNION ALL
          SELECT c.region, month_start, NULL, NULL, CAST({LATE30} AS DOUBLE) / nullif({ACTIVE_LOANS}, 0), NULL
          FROM fct_loans_monthly t LEFT JOIN dim_customers c ON t.customer_id = c.customer_id GROUP BY 1, 2
          UNION ALL
          SELECT c.region, month_start, NULL, NULL, NULL, avg(avg_daily_balance)
          FROM fct_account_balances_monthly t LEFT JOIN dim_customers c ON t.customer_id = c.customer_id GROUP BY 1, 2)
        GROUP BY 1, 2""",
    real="transaction_volume, net_interest_income",
    dates="period",
)
register(
    "metric_spine_filled_by_day",
    ask(["fee_revenue_net", "transaction_count"], grain="day", spine=True, fill=True, where={"home_branch_name": lambda c: c == "NATION_3"}),
    f"""SELECT d.date_key AS period, coalesce(f, 0) AS fee_revenue_net, coalesce(n, 0) AS transaction_count
        FROM dim_date d LEFT JOIN (SELECT transaction_date, {FEES_NET} AS f, count(*) AS n FROM fct_transactions
                                   WHERE home_branch_name = 'NATION_3' GROUP BY 1) t ON t.transaction_date = d.date_key""",
    real="fee_revenue_net",
    whole="transaction_count",
    dates="period",
)

ACCOUNT_PRODUCT = "(SELECT account_id, max(product_id) AS told FROM fct_interest_monthly GROUP BY 1)"
LOAN_STATUS = """(SELECT customer_id, CASE WHEN last >= 90 THEN '90+' WHEN last >= 30 THEN '30-89' WHEN last >= 0 THEN 'current' END AS told, lost
    FROM (SELECT customer_id, arg_max(days_past_due, (month_start, days_past_due)) AS last, bool_or(write_off_flag) AS lost FROM fct_loans_monthly GROUP BY 1))"""
register(
    "metric_transactions_by_account_product",
    ask(TRANSACTION_METRICS, by=["account__interest__product_id"]),
    f"""SELECT p.told AS account__interest__product_id, {TRANSACTION_SQL}
        FROM fct_transactions t LEFT JOIN {ACCOUNT_PRODUCT} p ON p.account_id = t.account_id GROUP BY 1""",
    real=TRANSACTION_REAL,
    whole="transaction_count, account__interest__product_id",
)
register(
    "metric_transactions_by_loan_status_and_region",
    ask(TRANSACTION_METRICS, by=["customer__loan_status", "customer__region"], grain="year"),
    f"""SELECT l.told AS customer__loan_status, c.region AS customer__region, CAST(date_trunc('year', transaction_date) AS DATE) AS period, {TRANSACTION_SQL}
        FROM fct_transactions t LEFT JOIN {LOAN_STATUS} l ON l.customer_id = t.customer_id
             LEFT JOIN dim_customers c ON c.customer_id = t.customer_id GROUP BY 1, 2, 3""",
    real=TRANSACTION_REAL,
    whole="transaction_count",
    dates="period",
)
register(
    "metric_balances_of_customers_with_lost_loans",
    ask(["average_daily_balance", "month_end_balance"], by=["product_id"], where={"customer__has_written_off_loan": lambda c: c}, digits=4),
    f"""SELECT b.product_id, round(avg(avg_daily_balance), 4) AS average_daily_balance, round(avg(CAST(month_end_balance AS DOUBLE)), 4) AS month_end_balance
        FROM fct_account_balances_monthly b JOIN {LOAN_STATUS} l ON l.customer_id = b.customer_id WHERE l.lost GROUP BY 1""",
    whole="product_id",
)
register(
    "metric_customers_by_loan_status",
    ask(["customer_count", "customer_inactivity_rate"], by=["customer__loan_status"]),
    f"""SELECT l.told AS customer__loan_status, {CUSTOMERS.replace("customer_id", "c.customer_id")} AS customer_count,
               {share(INACTIVE, CUSTOMERS).replace("customer_id", "c.customer_id")} AS customer_inactivity_rate
        FROM dim_customers c LEFT JOIN {LOAN_STATUS} l ON l.customer_id = c.customer_id GROUP BY 1""",
)


def spine_sql(grain: str, group: str, groups: str, body: str, values: str) -> str:
    """Each group beside each period of the calendar, with the values of ``body`` where it has them."""
    return f"""SELECT g.{group}, d.period, {values}
        FROM ({groups}) g CROSS JOIN (SELECT DISTINCT CAST(date_trunc('{grain}', date_key) AS DATE) AS period FROM dim_date) d
             LEFT JOIN ({body}) t ON t.{group} IS NOT DISTINCT FROM g.{group} AND t.period = d.period"""


register(
    "metric_spine_fees_by_branch_and_month",
    ask(["fee_revenue_net", "transaction_count"], by=["home_branch_name"], grain="month", spine=True, fill=True),
    spine_sql(
        "month", "home_branch_name", "SELECT DISTINCT home_branch_name FROM fct_transactions",
        f"""SELECT home_branch_name, CAST(date_trunc('month', transaction_date) AS DATE) AS period, {FEES_NET} AS f, count(*) AS n
            FROM fct_transactions GROUP BY 1, 2""",
        "coalesce(f, 0) AS fee_revenue_net, coalesce(n, 0) AS transaction_count",
    ),
    real="fee_revenue_net",
    whole="transaction_count",
    dates="period",
)
register(
    "metric_spine_rates_by_region_and_month",
    ask(["delinquency_rate_30d", "delinquent_30d_count", "total_loan_count"], by=["customer__region"], grain="month", spine=True, fill=True),
    spine_sql(
        "month", "customer__region", "SELECT DISTINCT region AS customer__region FROM fct_loans_monthly l LEFT JOIN dim_customers c ON c.customer_id = l.customer_id",
        f"""SELECT c.region AS customer__region, month_start AS period, {share(LATE30, ACTIVE_LOANS)} AS rate, {LATE30} AS late, {LOANS} AS loans
            FROM fct_loans_monthly l LEFT JOIN dim_customers c ON c.customer_id = l.customer_id GROUP BY 1, 2""",
        "rate AS delinquency_rate_30d, coalesce(late, 0) AS delinquent_30d_count, coalesce(loans, 0) AS total_loan_count",
    ),
    whole="delinquent_30d_count, total_loan_count",
    dates="period",
)
register(
    "metric_spine_balances_by_product_and_quarter",
    ask(["average_daily_balance", "net_interest_income"], by=["product_id"], grain="quarter", spine=True, fill=True, digits=4),
    spine_sql(
        "quarter", "product_id", "SELECT product_id FROM fct_account_balances_monthly UNION SELECT product_id FROM fct_interest_monthly",
        f"""SELECT product_id, period, max(b) AS b, max(i) AS i FROM (
              SELECT product_id, CAST(date_trunc('quarter', month_start) AS DATE) AS period, avg(avg_daily_balance) AS b, NULL AS i
              FROM fct_account_balances_monthly GROUP BY 1, 2
              UNION ALL SELECT product_id, CAST(date_trunc('quarter', month_start) AS DATE), NULL, {NII} FROM fct_interest_monthly GROUP BY 1, 2)
            GROUP BY 1, 2""",
        "round(b, 4) AS average_daily_balance, coalesce(i, 0) AS net_interest_income",
    ),
    real="net_interest_income",
    dates="period",
)


def change(t: Tables) -> DataFrame:
    series = m.query(marts(t), ["fee_revenue_net"], by=["home_branch_name"], grain="quarter")
    return m.compare_periods(series, "fee_revenue_net", by=["home_branch_name"])


register(
    "metric_fee_revenue_quarter_on_quarter",
    change,
    f"""WITH series AS (SELECT home_branch_name, CAST(date_trunc('quarter', transaction_date) AS DATE) AS period, {FEES_NET} AS v FROM fct_transactions GROUP BY 1, 2)
        SELECT home_branch_name, period, a.v AS current, b.v AS previous, coalesce(a.v, 0) - b.v AS delta
        FROM series a FULL JOIN (SELECT home_branch_name, CAST(period + INTERVAL 3 MONTH AS DATE) AS period, v FROM series) b USING (home_branch_name, period)
        WHERE a.v IS NOT NULL OR period <= (SELECT max(period) FROM series)""",
    real="current, previous, delta",
    dates="period",
)
register(
    "implicit_interest_totals_by_product",
    lambda t: m.implicit_totals(marts(t), "fct_interest_monthly", ["product_id"]),
    """SELECT product_id, sum(interest_income) AS interest_income, sum(interest_expense) AS interest_expense
       FROM fct_interest_monthly GROUP BY 1""",
    real="interest_income, interest_expense",
)
register(
    "implicit_interest_totals_by_month",
    lambda t: m.implicit_totals(marts(t), "fct_interest_monthly", ["month_start"]),
    """SELECT month_start, sum(interest_income) AS interest_income, sum(interest_expense) AS interest_expense,
              sum(outstanding_loan_balance) AS outstanding_loan_balance FROM fct_interest_monthly GROUP BY 1""",
    real="interest_income, interest_expense, outstanding_loan_balance",
    dates="month_start",
)
register(
    "implicit_balance_totals_by_product_and_month",
    lambda t: m.implicit_totals(marts(t), "fct_account_balances_monthly", ["product_id", "month_start"]),
    """SELECT product_id, month_start, sum(month_end_balance) AS month_end_balance
       FROM fct_account_balances_monthly GROUP BY 1, 2""",
    real="month_end_balance",
    dates="month_start",
)
LAST_OF_PERIOD = """SELECT {group}, CAST(date_trunc('{grain}', month_start) AS DATE) AS period, account_id, {sums}
    arg_max({balance}, month_start) FILTER ({balance} IS NOT NULL) AS {balance} FROM {mart} GROUP BY 1, 2, 3"""
register(
    "implicit_interest_totals_by_product_and_quarter",
    lambda t: m.implicit_totals(marts(t), "fct_interest_monthly", ["product_id"], grain="quarter"),
    "SELECT product_id, period, sum(interest_income) AS interest_income, sum(interest_expense) AS interest_expense, "
    "sum(outstanding_loan_balance) AS outstanding_loan_balance FROM ("
    + LAST_OF_PERIOD.format(
        group="product_id", grain="quarter", mart="fct_interest_monthly", balance="outstanding_loan_balance",
        sums="sum(interest_income) AS interest_income, sum(interest_expense) AS interest_expense,",
    )
    + ") GROUP BY 1, 2",
    real="interest_income, interest_expense, outstanding_loan_balance",
    dates="period",
)
register(
    "implicit_balance_totals_by_product_and_year",
    lambda t: m.implicit_totals(marts(t), "fct_account_balances_monthly", ["product_id"], grain="year"),
    "SELECT product_id, period, sum(month_end_balance) AS month_end_balance FROM ("
    + LAST_OF_PERIOD.format(group="product_id", grain="year", mart="fct_account_balances_monthly", balance="month_end_balance", sums="")
    + ") GROUP BY 1, 2",
    real="month_end_balance",
    dates="period",
)
register(
    "implicit_transaction_totals_by_type",
    lambda t: m.implicit_totals(marts(t), "fct_transactions", ["transaction_type"]),
    "SELECT transaction_type, sum(amount) AS amount FROM fct_transactions GROUP BY 1",
    real="amount",
)
register(
    "metric_transactions_of_no_customer",
    ask(["transaction_count", "transaction_volume"], where={"customer__region": lambda c: c == "NOWHERE"}),
    """SELECT count(*) AS transaction_count, sum(abs(f.amount)) AS transaction_volume
       FROM fct_transactions f JOIN dim_customers c ON f.customer_id = c.customer_id WHERE c.region = 'NOWHERE'""",
    real="transaction_volume",
)


def thinned(t: Tables) -> DataFrame:
    """Fee revenue by branch with one quarter's fees gone, against the quarter before."""
    rows = marts(t).ref("fct_transactions").where("NOT (year(transaction_date) = 2000 AND quarter(transaction_date) = 2)")
    series = m.query(marts(t).extend({"fct_transactions": lambda _: rows}), ["fee_revenue_net"], by=["home_branch_name"], grain="quarter")
    return m.compare_periods(series, "fee_revenue_net", by=["home_branch_name"])


register(
    "metric_fee_revenue_that_fell_to_nothing",
    thinned,
    f"""WITH series AS (SELECT home_branch_name, CAST(date_trunc('quarter', transaction_date) AS DATE) AS period, {FEES_NET} AS v
                        FROM fct_transactions WHERE NOT (year(transaction_date) = 2000 AND quarter(transaction_date) = 2) GROUP BY 1, 2)
        SELECT home_branch_name, period, a.v AS current, b.v AS previous, coalesce(a.v, 0) - b.v AS delta
        FROM series a FULL JOIN (SELECT home_branch_name, CAST(period + INTERVAL 3 MONTH AS DATE) AS period, v FROM series) b USING (home_branch_name, period)
        WHERE a.v IS NOT NULL OR period <= (SELECT max(period) FROM series)""",
    real="current, previous, delta",
    dates="period",
)
register(
    "home_branch_values",
    lambda t: m.dimension_values(marts(t), "fct_transactions", "home_branch_name"),
    "SELECT DISTINCT home_branch_name FROM fct_transactions",
)


# ------------------------------------------------------------------ report measures


def report(*args, digits: int = 6, **kwargs):
    def run(t: Tables) -> DataFrame:
        df = evaluate(marts(t), *args, **kwargs)
        reals = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
        return df.withColumns({c: F.round(f"`{c}`", digits) for c in reals})

    return run


register(
    "report_transactions_by_type",
    report(["Transaction Volume", "Net Fee Revenue"], by=["transaction_type"]),
    f"""SELECT transaction_type, {VOLUME} AS "Transaction Volume",
               (SELECT sum(-amount) FROM fct_transactions WHERE transaction_type = 'fee' AND NOT fee_waived) AS "Net Fee Revenue"
        FROM fct_transactions GROUP BY 1""",
    real="Transaction Volume, Net Fee Revenue",
)
register(
    "report_fees_by_branch_with_replaced_filter",
    report(["Net Fee Revenue"], by=["home_branch_name"], where={"transaction_type": lambda c: c == "deposit", "customer__region": lambda c: c == "ASIA"}),
    """SELECT v.home_branch_name, f."Net Fee Revenue"
       FROM (SELECT DISTINCT home_branch_name FROM fct_transactions t JOIN dim_customers c USING (customer_id)
             WHERE transaction_type = 'deposit' AND c.region = 'ASIA') v(home_branch_name)
       LEFT JOIN (SELECT t.home_branch_name, sum(-amount) AS "Net Fee Revenue"
                  FROM fct_transactions t JOIN dim_customers c USING (customer_id)
                  WHERE transaction_type = 'fee' AND NOT fee_waived AND c.region = 'ASIA' GROUP BY 1) f
         ON v.home_branch_name = f.home_branch_name""".replace("SELECT DISTINCT home_branch_name", "SELECT DISTINCT t.home_branch_name"),
    real="Net Fee Revenue",
)
register(
    "report_customers_by_activity",
    report(["Active Customer Count", "Customer Inactivity Rate"], by=["is_active"]),
    f"""SELECT is_active, (SELECT {ACTIVE} FROM dim_customers) AS "Active Customer Count",
               round(CAST((SELECT {INACTIVE} FROM dim_customers) AS DOUBLE) / {CUSTOMERS}, 6) AS "Customer Inactivity Rate"
        FROM dim_customers GROUP BY 1""",
)
register(
    "report_customers_by_region",
    report(["Active Customer Count", "Customer Inactivity Rate"], by=["region"]),
    f"""SELECT region, {ACTIVE} AS "Active Customer Count", {share(INACTIVE, CUSTOMERS)} AS "Customer Inactivity Rate"
        FROM dim_customers GROUP BY 1""",
)
register(
    "report_balances_by_calendar_quarter",
    report(["Average Daily Balance"], by=["date__year", "date__quarter"], digits=4),
    """SELECT d.year AS date__year, d.quarter AS date__quarter, round(avg(avg_daily_balance), 4) AS "Average Daily Balance"
       FROM fct_account_balances_monthly b LEFT JOIN dim_date d ON b.month_start = d.date_key GROUP BY 1, 2""",
    whole="date__year, date__quarter",
)
register(
    "report_interest_by_region_and_year",
    report(["Net Interest Income", "Net Interest Margin"], by=["customer__region", "date__year"], digits=8),
    f"""SELECT c.region AS customer__region, d.year AS date__year, {NII} AS "Net Interest Income",
               {share(NII, 'sum(outstanding_loan_balance)', 8)} AS "Net Interest Margin"
        FROM fct_interest_monthly i LEFT JOIN dim_customers c ON i.customer_id = c.customer_id
             LEFT JOIN dim_date d ON i.month_start = d.date_key GROUP BY 1, 2""",
    whole="date__year",
    real="Net Interest Income",
)
LOAN_REPORT = ["Delinquency Rate 30D", "Delinquency Rate 90D", "Charge-off Rate"]
register(
    "report_loan_rates_by_month",
    report(LOAN_REPORT, by=["date__year", "date__month"]),
    f"""SELECT d.year AS date__year, d.month AS date__month, {share(LATE30, ACTIVE_ROWS)} AS "Delinquency Rate 30D",
               {share(LATE90, ACTIVE_ROWS)} AS "Delinquency Rate 90D", {share(LOST, 'count(*)')} AS "Charge-off Rate"
        FROM fct_loans_monthly l LEFT JOIN dim_date d ON l.month_start = d.date_key GROUP BY 1, 2""",
    whole="date__year, date__month",
)
register(
    "report_loan_rates_by_write_off_flag",
    report(LOAN_REPORT, by=["write_off_flag"]),
    f"""SELECT write_off_flag, (SELECT {share(LATE30, ACTIVE_ROWS)} FROM fct_loans_monthly) AS "Delinquency Rate 30D",
               (SELECT {share(LATE90, ACTIVE_ROWS)} FROM fct_loans_monthly) AS "Delinquency Rate 90D",
               round(CAST((SELECT {LOST} FROM fct_loans_monthly) AS DOUBLE) / count(*), 6) AS "Charge-off Rate"
        FROM fct_loans_monthly GROUP BY 1""",
)
