"""Reference questions: grouped templates, scalar forms, and the golden answers of the question set."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.oracle_tables import TABLES
from checks.registry import register
from ledgerline import Tables
from ledgerline.functions.calendar import Period
from ledgerline.operators.joins import lookup
from ledgerline.plans import metrics as m
from ledgerline.plans import reference_questions as q

FEE = "t.transaction_type = 'fee' AND NOT t.is_reversal"
NET_FEE = f"{FEE} AND NOT t.fee_waived"


def start_of(grain: str, day: str = "t.transaction_date") -> str:
    return f"CAST(date_trunc('{grain}', {day}) AS DATE) AS period"


# ------------------------------------------------------------------ grouped templates

for _net in (True, False):
    _label = "net" if _net else "gross"
    for _grain in ("quarter", "year"):
        register(
            f"question_{_label}_fee_revenue_by_{_grain}",
            lambda t, net=_net, grain=_grain: q.fee_revenue(t, net, grain),
            f"SELECT {start_of(_grain)}, -sum(t.amount) AS fee_revenue FROM fact_transaction t WHERE {NET_FEE if _net else FEE} GROUP BY 1",
            real="fee_revenue",
            dates="period",
        )
register(
    "question_net_fee_revenue_in_quarter",
    lambda t: q.fee_revenue(t, True, period=Period.quarter(2001, 1)),
    f"""SELECT -sum(t.amount) AS fee_revenue FROM fact_transaction t WHERE {NET_FEE}
        AND year(t.transaction_date) = 2001 AND quarter(t.transaction_date) = 1""",
    real="fee_revenue",
)
register(
    "question_net_fee_revenue_by_product_and_year",
    lambda t: q.net_fee_revenue_by_product(t, grain="year"),
    f"""SELECT p.product_name, {start_of('year')}, -sum(t.amount) AS fee_revenue FROM fact_transaction t JOIN owner USING (account_id)
        JOIN dim_product p USING (product_id) WHERE {NET_FEE} GROUP BY 1, 2""",
    real="fee_revenue",
    dates="period",
)
register(
    "question_net_fee_revenue_of_products",
    lambda t: q.net_fee_revenue_by_product(t, ["Chequing", "Savings"], period=Period.year(1999)),
    f"""SELECT p.product_name, -sum(t.amount) AS fee_revenue FROM fact_transaction t JOIN owner USING (account_id)
        JOIN dim_product p USING (product_id) WHERE {NET_FEE} AND p.product_name IN ('Chequing', 'Savings') AND year(t.transaction_date) = 1999 GROUP BY 1""",
    real="fee_revenue",
)
for _day in ("posting_date", "transaction_date"):
    register(
        f"question_transaction_count_by_{_day}_quarter",
        lambda t, day=_day: q.transaction_count(t, day, "quarter"),
        f"SELECT {start_of('quarter', 't.' + _day)}, count(*) AS transactions FROM customer_ledger t GROUP BY 1",
        dates="period",
    )
    register(
        f"question_governed_volume_by_{_day}_quarter",
        lambda t, day=_day: q.governed_volume(t, day, "quarter"),
        f"SELECT {start_of('quarter', 't.' + _day)}, sum(abs(t.amount)) AS volume FROM governed_ledger t GROUP BY 1",
        real="volume",
        dates="period",
    )
register(
    "question_customer_volume_by_year",
    lambda t: q.governed_volume(t, grain="year"),
    f"SELECT {start_of('year')}, sum(abs(t.amount)) AS volume FROM governed_ledger t GROUP BY 1",
    real="volume",
    dates="period",
)
register(
    "question_netted_volume_by_year",
    lambda t: q.netted_volume(t, "year"),
    f"SELECT {start_of('year')}, sum(abs(t.amount)) AS volume FROM netted_ledger t GROUP BY 1",
    real="volume",
    dates="period",
)
register(
    "question_naive_volume_by_year",
    lambda t: q.naive_volume(t, "year"),
    f"SELECT {start_of('year')}, sum(abs(t.amount)) AS volume FROM fact_transaction t GROUP BY 1",
    real="volume",
    dates="period",
)
register(
    "question_reversed_originals_by_year",
    lambda t: q.reversed_originals(t, "year"),
    f"SELECT {start_of('year')}, count(DISTINCT t.transaction_id) AS reversed_transactions FROM fact_transaction t JOIN undone u ON t.transaction_id = u.transaction_id GROUP BY 1",
    dates="period",
)
register(
    "question_customer_count_by_year",
    lambda t: q.transaction_count(t, grain="year"),
    f"SELECT {start_of('year')}, count(*) AS transactions FROM customer_ledger t GROUP BY 1",
    dates="period",
)
register(
    "question_count_with_internal_by_year",
    lambda t: q.transaction_count(t, grain="year", internal=True),
    f"SELECT {start_of('year')}, count(*) AS transactions FROM fact_transaction t GROUP BY 1",
    dates="period",
)
register(
    "question_volume_by_home_branch_and_year",
    lambda t: q.governed_volume_by_home_branch(t, "year"),
    f"""SELECT b.branch_name AS home_branch_name, {start_of('year')}, sum(abs(t.amount)) AS volume FROM governed_ledger t JOIN owner USING (account_id)
        JOIN dim_branch b ON b.branch_id = home_branch_id GROUP BY 1, 2""",
    real="volume",
    dates="period",
)
register(
    "question_volume_of_home_branch",
    lambda t: q.governed_volume_by_home_branch(t, period=Period.year(2000), branch="NATION_7"),
    f"""SELECT b.branch_name AS home_branch_name, sum(abs(t.amount)) AS volume FROM governed_ledger t JOIN owner USING (account_id)
        JOIN dim_branch b ON b.branch_id = home_branch_id WHERE b.branch_name = 'NATION_7' AND year(t.transaction_date) = 2000 GROUP BY 1""",
    real="volume",
)
register(
    "question_count_at_transaction_branch_and_year",
    lambda t: q.count_at_transaction_branch(t, "year"),
    f"""SELECT b.branch_name AS transaction_branch_name, {start_of('year')}, count(*) AS transactions FROM customer_ledger t
        JOIN dim_branch b USING (branch_id) GROUP BY 1, 2""",
    dates="period",
)
register(
    "question_active_customers_by_region",
    lambda t: q.active_customers(t),
    "SELECT region, count(*) AS active_customers FROM dim_customer WHERE is_active GROUP BY 1",
)
register(
    "question_open_account_customers_by_region",
    lambda t: q.customers_with_open_account(t),
    """SELECT region, count(*) AS customers FROM dim_customer
       WHERE customer_id IN (SELECT customer_id FROM dim_account WHERE status = 'open') GROUP BY 1""",
)


def _daily_mean(grain: str):
    return lambda t: q.average_daily_balance(t, grain).withColumn("average_daily_balance", F.round("average_daily_balance", 4))


for _grain in ("month", "quarter"):
    register(
        f"question_average_daily_balance_by_{_grain}",
        _daily_mean(_grain),
        f"""SELECT CAST(date_trunc('{_grain}', balance_date) AS DATE) AS period,
                   round(avg(CAST(balance_amount AS DOUBLE)), 4) AS average_daily_balance FROM fact_daily_balance GROUP BY 1""",
        dates="period",
    )
register(
    "question_average_daily_balance_in_range",
    lambda t: q.average_daily_balance(t, None, date(2001, 4, 1), date(2001, 6, 30)).select(
        F.round("average_daily_balance", 2).alias("average_daily_balance")
    ),
    """SELECT round(avg(CAST(balance_amount AS DOUBLE)), 2) AS average_daily_balance FROM fact_daily_balance
       WHERE balance_date BETWEEN '2001-04-01' AND '2001-06-30'""",
)
register(
    "question_total_balance_by_date",
    lambda t: q.total_balance(t),
    "SELECT balance_date, sum(balance_amount) AS total_balance FROM fact_daily_balance GROUP BY 1",
    real="total_balance",
    dates="balance_date",
)

AS_OF_DATES = [date(2001, 6, 30), date(2001, 3, 31), date(2000, 12, 31)]


def _standing(day: date | str) -> str:
    """Active loans with their last known status on a day."""
    return f"""(SELECT product_id, dpd FROM owner JOIN
                 (SELECT loan_account_id AS account_id, arg_max(days_past_due, (payment_date, days_past_due)) AS dpd
                  FROM fact_loan_payment WHERE payment_date <= DATE '{day}' GROUP BY ALL) USING (account_id)
                WHERE NOT write_off_flag)"""


def _delinquency_sql(days: int, product: bool) -> str:
    key, join = ("product_name, ", "JOIN dim_product USING (product_id)") if product else ("", "")
    parts = [
        f"""SELECT {key}'{d}' AS as_of, count(*) AS active_loans, count(*) FILTER (dpd >= {days}) AS delinquent_loans,
                   round(100.0 * count(*) FILTER (dpd >= {days}) / count(*), 2) AS delinquency_rate
            FROM {_standing(d)} {join} GROUP BY ALL"""
        for d in AS_OF_DATES
    ]
    return " UNION ALL ".join(parts)


for _days in (30, 60):
    register(
        f"question_delinquency_{_days}_as_of_dates",
        lambda t, days=_days: q.delinquency_as_of(t, AS_OF_DATES, days),
        _delinquency_sql(_days, False),
        whole="active_loans, delinquent_loans",
        real="delinquency_rate",
    )


def _delinquency_by_product(t: Tables) -> DataFrame:
    named = t.ref("dim_product").select("product_id", "product_name")
    by_id = q.delinquency_as_of(t, AS_OF_DATES, 30, ["product_id"])
    return by_id.join(named, "product_id").drop("product_id")


register(
    "question_delinquency_by_product_as_of_dates",
    _delinquency_by_product,
    _delinquency_sql(30, True),
    whole="active_loans, delinquent_loans",
    real="delinquency_rate",
)
register(
    "question_written_off_loans_by_product",
    lambda t: q.written_off_loans(t),
    """SELECT product_name, count(*) AS written_off_loans FROM owner JOIN dim_product USING (product_id)
       WHERE product_type = 'loan' AND write_off_flag GROUP BY 1""",
)
register(
    "question_balance_of_active_by_region_and_product",
    lambda t: q.average_balance_of_active(t, date(2001, 4, 1), date(2001, 6, 30)).withColumn(
        "average_daily_balance", F.round("average_daily_balance", 4)
    ),
    """SELECT c.region, p.product_name, round(avg(CAST(b.balance_amount AS DOUBLE)), 4) AS average_daily_balance
       FROM fact_daily_balance b JOIN dim_account a ON b.account_id = a.account_id
            JOIN dim_customer c ON a.customer_id = c.customer_id JOIN dim_product p ON a.product_id = p.product_id
       WHERE c.is_active AND b.balance_date BETWEEN DATE '2001-04-01' AND DATE '2001-06-30' GROUP BY 1, 2""",
)


def next_quarter(t: Tables) -> DataFrame:
    """The same question for the following quarter, next to the quarter first asked about."""
    series = q.fee_revenue(t, True, "quarter")
    return m.compare_periods(series, "fee_revenue").select("period", "previous", "current", "delta")


QUARTERLY_FEES = f"SELECT {start_of('quarter')}, -sum(t.amount) AS v FROM fact_transaction t WHERE {NET_FEE} GROUP BY 1"
register(
    "question_follow_up_next_quarter",
    next_quarter,
    f"""SELECT a.period, b.v AS previous, a.v AS current, a.v - b.v AS delta
        FROM ({QUARTERLY_FEES}) a LEFT JOIN ({QUARTERLY_FEES}) b ON b.period = a.period - INTERVAL 3 MONTH""",
    real="previous, current, delta",
    dates="period",
)


def year_on_year(t: Tables) -> DataFrame:
    now, before = Period.quarter(2001, 1), Period.quarter(2000, 1)
    fees = t.ref("fact_transaction").where(
        (F.col("transaction_type") == "fee")
        & ~F.col("is_reversal")
        & ~F.col("fee_waived")
        & (now.contains(F.col("transaction_date")) | before.contains(F.col("transaction_date")))
    )
    value = lambda p: -F.sum(F.when(p.contains(F.col("transaction_date")), F.col("amount")))
    return fees.agg(value(now).alias("current"), value(before).alias("previous")).withColumn(
        "delta", F.col("current") - F.col("previous")
    )


register(
    "question_quarter_against_year_before",
    year_on_year,
    f"""SELECT c AS current, p AS previous, c - p AS delta FROM (
          SELECT -sum(CASE WHEN year(t.transaction_date) = 2001 THEN t.amount END) AS c,
                 -sum(CASE WHEN year(t.transaction_date) = 2000 THEN t.amount END) AS p
          FROM fact_transaction t WHERE {NET_FEE} AND quarter(t.transaction_date) = 1)""",
    real="current, previous, delta",
)


def home_and_transaction_branch(t: Tables) -> DataFrame:
    """Both branch readings of every governed row, counted by the pair."""
    return t.ref("fct_transactions").groupBy("home_branch_name", "transaction_branch_name").agg(
        F.count(F.lit(1)).alias("transactions")
    )


register(
    "home_against_transaction_branch",
    home_and_transaction_branch,
    "SELECT home_branch_name, transaction_branch_name, count(*) AS transactions FROM fct_transactions GROUP BY 1, 2",
)


def reversal_pairs(t: Tables) -> DataFrame:
    """Each reversal next to its original."""
    rows = t.ref("fact_transaction")
    reversal = rows.where(F.col("reversal_of_transaction_id").isNotNull()).select(
        F.col("transaction_id").alias("reversal_id"),
        F.col("reversal_of_transaction_id").alias("transaction_id"),
        F.col("transaction_date").alias("reversed_on"),
        F.col("amount").alias("reversed_amount"),
    )
    original = rows.select("transaction_id", "transaction_date", "amount")
    return lookup(reversal, original, "transaction_id").select(
        "reversal_id",
        "transaction_id",
        F.datediff("reversed_on", "transaction_date").alias("days_later"),
        (F.col("amount") + F.col("reversed_amount")).alias("net"),
    )


register(
    "reversals_with_originals",
    reversal_pairs,
    """SELECT r.transaction_id AS reversal_id, o.transaction_id, date_diff('day', o.transaction_date, r.transaction_date) AS days_later,
              o.amount + r.amount AS net
       FROM fact_transaction r JOIN fact_transaction o ON r.reversal_of_transaction_id = o.transaction_id""",
    whole="days_later",
    real="net",
)

NOTHING = Period.year(1980)
_IN_1980 = "year({}) = 1980"
register(
    "question_counts_over_nothing",
    lambda t: q.transaction_count(t, "posting_date", period=NOTHING).select(F.lit("posted").alias("question"), "transactions")
    .unionByName(q.transaction_count(t, period=NOTHING).select(F.lit("initiated").alias("question"), "transactions"))
    .unionByName(q.transaction_count(t, period=NOTHING, internal=True).select(F.lit("with internal").alias("question"), "transactions"))
    .unionByName(q.count_at_branch(t, "NATION_6", NOTHING).select(F.lit("at a branch").alias("question"), "transactions"))
    .unionByName(q.reversed_originals(t, period=NOTHING).select(F.lit("reversed").alias("question"), F.col("reversed_transactions").alias("transactions"))),
    f"""SELECT 'posted' AS question, count(*) AS transactions FROM customer_ledger WHERE {_IN_1980.format("posting_date")}
        UNION ALL SELECT 'initiated', count(*) FROM customer_ledger WHERE {_IN_1980.format("transaction_date")}
        UNION ALL SELECT 'with internal', count(*) FROM fact_transaction WHERE {_IN_1980.format("transaction_date")}
        UNION ALL SELECT 'at a branch', count(*) FROM customer_ledger JOIN dim_branch USING (branch_id)
                         WHERE branch_name = 'NATION_6' AND {_IN_1980.format("transaction_date")}
        UNION ALL SELECT 'reversed', count(*) FROM fact_transaction JOIN undone USING (transaction_id) WHERE {_IN_1980.format("transaction_date")}""",
)
register(
    "question_count_at_branch",
    lambda t: q.count_at_branch(t, "NATION_6", Period.year(2000)),
    """SELECT count(*) AS transactions FROM customer_ledger JOIN dim_branch USING (branch_id)
       WHERE branch_name = 'NATION_6' AND year(transaction_date) = 2000""",
)

# ------------------------------------------------------------------ a ledger with odd rows

ODD_IDS = 3 * 10**15


def odd(t: Tables) -> Tables:
    """The ledger and copies of some of its rows: of an unknown account, of no account, and reversed twice."""
    rows = t.ref("fact_transaction")
    k = F.col("transaction_id")
    first = rows.where(~F.col("is_reversal"))
    more = (
        first.where(k % 50 == 1).withColumns({"transaction_id": k + ODD_IDS, "account_id": F.lit(-1).cast("long")})
        .unionByName(first.where(k % 50 == 2).withColumns({"transaction_id": k + ODD_IDS, "account_id": F.lit(None).cast("long")}))
        .unionByName(rows.where("is_reversal").withColumn("transaction_id", k + ODD_IDS))
    )
    return t.extend({"fact_transaction": lambda _: rows.unionByName(more)})


def _odd_row(account: str, condition: str) -> str:
    return f"""SELECT transaction_id + {ODD_IDS}, {account}, transaction_date, posting_date, branch_id, transaction_type, amount, fee_waived,
                      is_reversal, reversal_of_transaction_id FROM sound WHERE {condition}"""


ODD_LEDGER = {
    "fact_transaction": f"""
        WITH sound AS ({TABLES["fact_transaction"]})
        SELECT * FROM sound
        UNION ALL {_odd_row("-1", "NOT is_reversal AND transaction_id % 50 = 1")}
        UNION ALL {_odd_row("NULL", "NOT is_reversal AND transaction_id % 50 = 2")}
        UNION ALL {_odd_row("account_id", "is_reversal")}"""
}
register(
    "odd_ledger_governed_volume_by_year",
    lambda t: q.governed_volume(odd(t), grain="year"),
    f"SELECT {start_of('year')}, sum(abs(t.amount)) AS volume FROM governed_ledger t GROUP BY 1",
    real="volume",
    dates="period",
    extra=ODD_LEDGER,
)
register(
    "odd_ledger_netted_volume_by_year",
    lambda t: q.netted_volume(odd(t), "year"),
    f"SELECT {start_of('year')}, sum(abs(t.amount)) AS volume FROM netted_ledger t GROUP BY 1",
    real="volume",
    dates="period",
    extra=ODD_LEDGER,
)
register(
    "odd_ledger_customer_count_by_year",
    lambda t: q.transaction_count(odd(t), grain="year"),
    f"SELECT {start_of('year')}, count(*) AS transactions FROM customer_ledger t GROUP BY 1",
    dates="period",
    extra=ODD_LEDGER,
)
register(
    "odd_ledger_reversed_originals_by_year",
    lambda t: q.reversed_originals(odd(t), "year"),
    f"SELECT {start_of('year')}, count(DISTINCT t.transaction_id) AS reversed_transactions FROM fact_transaction t JOIN undone u ON t.transaction_id = u.transaction_id GROUP BY 1",
    dates="period",
    extra=ODD_LEDGER,
)
register(
    "odd_ledger_fct_transactions",
    lambda t: odd(t).ref("fct_transactions"),
    "SELECT * FROM fct_transactions",
    real="amount",
    dates="transaction_date, posting_date",
    extra=ODD_LEDGER,
)

# ------------------------------------------------------------------ golden answers

Y = {y: Period.year(y) for y in (1999, 2000)}


# what a condition on the prepared ledger is called on the raw tables, and the join that brings it
_RAW_COLUMNS = {
    "is_internal": ("a.is_internal", "account"),
    "product_name": ("p.product_name", "product"),
    "home_branch_name": ("h.branch_name", "home"),
    "transaction_branch_name": ("b.branch_name", "place"),
    "is_reversed": ("r.transaction_id IS NOT NULL", "reversed"),
}
_JOINS = {
    "account": "JOIN dim_account a ON a.account_id = t.account_id",
    "product": "JOIN dim_product p ON p.product_id = a.product_id",
    "home": "JOIN dim_branch h ON h.branch_id = a.home_branch_id",
    "place": "JOIN dim_branch b ON b.branch_id = t.branch_id",
    "reversed": "LEFT JOIN (SELECT DISTINCT reversal_of_transaction_id AS transaction_id FROM fact_transaction "
    "WHERE reversal_of_transaction_id IS NOT NULL) r ON r.transaction_id = t.transaction_id",
}
_RAW_TOTALS = {"amount": "-sum(t.amount)", "volume": "sum(abs(t.amount))", "transactions": "count(*)", "reversed_rows": "count(*)"}


def _ledger_sql(column: str, condition: str, period: Period, day: str) -> str:
    needed, raw = set(), condition + (" AND is_reversed" if column == "reversed_rows" else "")
    for name, (expression, join) in _RAW_COLUMNS.items():
        if re.search(rf"\b{name}\b", raw):
            needed |= {join} | ({"account"} if join in ("product", "home") else set())
            raw = re.sub(rf"\b{name}\b", f"({expression})" if " " in expression else expression, raw)
    raw = re.sub(r"\b(transaction_type|fee_waived|is_reversal)\b", r"t.\1", raw)
    joins = " ".join(text for name, text in _JOINS.items() if name in needed)
    return (
        f"SELECT {_RAW_TOTALS[column]} AS answer FROM fact_transaction t {joins} WHERE {raw} "
        f"AND t.{day}_date >= DATE '{period.start}' AND t.{day}_date < DATE '{period.end}'"
    )


def _ledger_text(column: str, condition: str, period: Period, day: str) -> str:
    what = {
        "amount": "net fee revenue" if "fee_waived" in condition else "gross fee revenue",
        "volume": "transaction volume",
        "transactions": "number of transactions",
        "reversed_rows": "number of transactions later reversed",
    }[column]
    names = re.findall(r"'([^']+)'", condition.replace("'fee'", ""))
    where = "at transaction branch " if "transaction_branch" in condition else "of home branch " if "home_branch" in condition else "of "
    parts = [f"What was the {what}"]
    if names:
        parts.append(where + " and ".join(names))
    if "NOT is_reversed" in condition:
        parts.append("net of reversed pairs")
    if "NOT is_internal" in condition:
        parts.append("without the bank's own accounts")
    return " ".join(parts) + f", by {day} date from {period.start} until {period.end}?"


def _ledger(id_: str, tag: str, aggregate: str, condition: str, period: Period, day: str = "transaction") -> q.Question:
    month = f"{day}_month >= date'{period.start}' AND {day}_month < date'{period.end}'"
    function, column = aggregate.split()
    sign = "-" if column == "amount" else ""
    answer = f"{sign}{function}(CASE WHEN {condition} AND {month} THEN {column} END)"
    if column in ("transactions", "reversed_rows"):  # counts, summed from the months' counts
        answer = f"coalesce({answer}, 0)"
    return q.Question(id_, tag, "ledger", answer, _ledger_text(column, condition, period, day), _ledger_sql(column, condition, period, day))


_FEE = "transaction_type = 'fee' AND NOT is_reversal"
_NET_FEE = f"{_FEE} AND NOT fee_waived"
_CUSTOMER = "NOT is_internal"
_NETTED = "NOT is_reversal AND NOT is_reversed"
_GOVERNED = f"{_CUSTOMER} AND {_NETTED}"
_ALL = "true"

R, D, O, B, W, V, I, L = (
    "gross_vs_net_revenue", "posting_vs_transaction_date", "open_vs_active_account", "month_end_vs_avg_daily_balance",
    "written_off_loans", "reversed_transactions", "internal_accounts", "customer_vs_branch_location",
)


def _mean(id_: str, first: str, last: str) -> q.Question:
    return q.Question(
        id_, B, "balances", f"avg(CASE WHEN balance_date BETWEEN date'{first}' AND date'{last}' THEN CAST(balance_amount AS double) END)",
        f"What was the average daily balance from {first} to {last}?",
        f"SELECT avg(CAST(balance_amount AS double)) AS answer FROM fact_daily_balance WHERE balance_date BETWEEN DATE '{first}' AND DATE '{last}'",
    )


def _sum_on(id_: str, day: str) -> q.Question:
    return q.Question(
        id_, B, "balances", f"sum(CASE WHEN balance_date = date'{day}' THEN balance_amount END)",
        f"What did all balances add up to at the end of {day}?",
        f"SELECT sum(balance_amount) AS answer FROM fact_daily_balance WHERE balance_date = DATE '{day}'",
    )


def _active_book(measure: str, day: str) -> str:
    return (
        f"SELECT {measure} AS answer FROM (SELECT loan_account_id, max_by(days_past_due, struct(payment_date, days_past_due)) AS days_past_due "
        f"FROM fact_loan_payment WHERE payment_date <= DATE '{day}' GROUP BY loan_account_id) l "
        "JOIN dim_account a ON a.account_id = l.loan_account_id WHERE NOT a.write_off_flag"
    )


def _rate(id_: str, day: str) -> q.Question:
    return q.Question(
        id_, W, "loans", f"try_divide(100.0D * count(CASE WHEN as_of = date'{day}' AND days_past_due >= 30 THEN 1 END), count(CASE WHEN as_of = date'{day}' THEN 1 END))",
        f"What percentage of active loans was 30 or more days past due on {day}?",
        _active_book("try_divide(100.0D * count_if(l.days_past_due >= 30), count(*))", day),
    )


def _late(id_: str, day: str) -> q.Question:
    return q.Question(
        id_, W, "loans", f"count(CASE WHEN as_of = date'{day}' AND days_past_due >= 60 THEN 1 END)",
        f"How many active loans were 60 or more days past due on {day}?",
        _active_book("count_if(l.days_past_due >= 60)", day),
    )


def _customers(id_: str, condition: str) -> q.Question:
    kind = "are active" if "is_active" in condition else "have an open account"
    region = re.search(r"region = '(\w+)'", condition)
    open_account = "c.customer_id IN (SELECT customer_id FROM dim_account WHERE status = 'open')"
    return q.Question(
        id_, O, "customers", f"count(CASE WHEN {condition} THEN 1 END)",
        f"How many customers{f' in {region[1]}' if region else ''} {kind}?",
        f"SELECT count(*) AS answer FROM dim_customer c WHERE {condition.replace('has_open_account', open_account)}",
    )


def _unanswerable(id_: str, text: str) -> q.Question:
    return q.Question(id_, "", "", "", text, answerable=False)


QUESTIONS = [
    _ledger("dev-01", R, "sum amount", _NET_FEE, Period.quarter(2001, 1)),
    _ledger("dev-02", R, "sum amount", _FEE, Y[2000]),
    _ledger("dev-03", R, "sum amount", f"{_NET_FEE} AND product_name IN ('Chequing', 'Savings')", Y[1999]),
    _ledger("dev-04", D, "sum transactions", _CUSTOMER, Period.quarter(2000, 1), "posting"),
    _ledger("dev-05", D, "sum transactions", _CUSTOMER, Period.quarter(2000, 1)),
    _ledger("dev-06", D, "sum volume", _GOVERNED, Period.quarter(2000, 3)),
    _customers("dev-07", "is_active AND region = 'ASIA'"),
    _customers("dev-08", "has_open_account AND region = 'EUROPE'"),
    _customers("dev-09", "is_active AND region = 'EUROPE'"),
    _mean("dev-10", "2001-04-01", "2001-06-30"),
    _sum_on("dev-11", "2001-03-31"),
    _mean("dev-12", "2001-04-01", "2001-04-30"),
    _rate("dev-13", "2001-03-31"),
    _late("dev-14", "2001-03-31"),
    q.Question(
        "dev-15", W, "accounts", "count(CASE WHEN product_type = 'loan' AND write_off_flag THEN 1 END)", "How many loans have been written off?",
        "SELECT count(*) AS answer FROM dim_account a JOIN dim_product p ON p.product_id = a.product_id WHERE p.product_type = 'loan' AND a.write_off_flag",
    ),
    _ledger("dev-16", V, "sum volume", _NETTED, Y[1999]),
    _ledger("dev-17", V, "sum reversed_rows", _ALL, Y[1999]),
    _ledger("dev-18", V, "sum volume", _ALL, Y[2000]),
    _ledger("dev-19", I, "sum volume", _GOVERNED, Y[1999]),
    _ledger("dev-20", I, "sum transactions", _CUSTOMER, Y[1999]),
    _ledger("dev-21", I, "sum transactions", _ALL, Y[2000]),
    _ledger("dev-22", L, "sum volume", f"{_GOVERNED} AND home_branch_name = 'NATION_3'", Y[2000]),
    _ledger("dev-23", L, "sum transactions", f"{_CUSTOMER} AND transaction_branch_name = 'NATION_6'", Y[2000]),
    _ledger("dev-24", L, "sum volume", f"{_GOVERNED} AND home_branch_name = 'NATION_4'", Y[2000]),
    _ledger("holdout-01", R, "sum amount", _NET_FEE, Y[1999]),
    _ledger("holdout-02", R, "sum amount", _NET_FEE, Y[2000]),
    _ledger("holdout-03", R, "sum amount", f"{_NET_FEE} AND product_name = 'Credit Card'", Y[2000]),
    _ledger("holdout-04", D, "sum transactions", _CUSTOMER, Period.quarter(2000, 4), "posting"),
    _ledger("holdout-05", D, "sum transactions", _CUSTOMER, Period.quarter(2000, 4)),
    _ledger("holdout-06", D, "sum volume", _GOVERNED, Period.quarter(2001, 2), "posting"),
    _customers("holdout-07", "is_active"),
    _customers("holdout-08", "has_open_account"),
    _customers("holdout-09", "is_active AND region = 'AMERICA'"),
    _mean("holdout-10", "2001-06-01", "2001-06-30"),
    _sum_on("holdout-11", "2001-06-30"),
    _mean("holdout-12", "2001-05-01", "2001-05-31"),
    _rate("holdout-13", "2001-06-30"),
    _late("holdout-14", "2001-06-30"),
    _ledger("holdout-15", V, "sum volume", _NETTED, Y[2000]),
    _ledger("holdout-16", V, "sum reversed_rows", _ALL, Y[2000]),
    _ledger("holdout-17", I, "sum volume", _GOVERNED, Y[2000]),
    _ledger("holdout-18", I, "sum transactions", _CUSTOMER, Y[2000]),
    _ledger("holdout-19", L, "sum volume", f"{_GOVERNED} AND home_branch_name = 'NATION_5'", Y[2000]),
    _ledger("holdout-20", L, "sum transactions", f"{_CUSTOMER} AND transaction_branch_name = 'NATION_2'", Y[2000]),
    _unanswerable("oos-dev-01", "Which customers will leave us in the coming quarter?"),
    _unanswerable("oos-dev-02", "What revenue did each salesperson bring in?"),
    _unanswerable("oos-dev-03", "What is the central bank's policy rate today?"),
    _unanswerable("oos-dev-04", "How often was the mobile app opened last month?"),
    _unanswerable("oos-01", "What is the bank's capital ratio?"),
    _unanswerable("oos-02", "Which loans will default within half a year?"),
    _unanswerable("oos-03", "How many transactions did each teller handle?"),
    _unanswerable("oos-04", "How does our margin compare with a competitor's?"),
    _unanswerable("oos-05", "What is the credit score of each borrower?"),
    _unanswerable("oos-06", "How satisfied are customers with their branch?"),
    _unanswerable("oos-07", "What did each marketing campaign return?"),
    _unanswerable("oos-08", "What are the bank's bonds worth at market prices?"),
]


def _golden_sql() -> dict[str, str]:
    """Each answer on its own, over the reading its question asks for."""
    fees, volume, rows = "-sum(amount)", "sum(abs(amount))", "count(*)"
    mean, total = "avg(CAST(balance_amount AS DOUBLE))", "sum(balance_amount)"
    by_product = "fact_transaction t JOIN owner USING (account_id) JOIN dim_product USING (product_id)"
    by_home = "governed_ledger JOIN owner USING (account_id) JOIN dim_branch ON dim_branch.branch_id = home_branch_id"
    by_place = "customer_ledger JOIN dim_branch USING (branch_id)"
    reversed_rows = "fact_transaction JOIN undone USING (transaction_id)"
    holders = "dim_customer JOIN (SELECT DISTINCT customer_id FROM dim_account WHERE status = 'open') USING (customer_id)"
    gross, net = "transaction_type = 'fee' AND NOT is_reversal", "transaction_type = 'fee' AND NOT is_reversal AND NOT fee_waived"
    late = "100.0 * count(*) FILTER (dpd >= 30) / count(*)"

    def year(y: int, day: str = "transaction_date") -> str:
        return f"year({day}) = {y}"

    def quarter(y: int, n: int, day: str = "transaction_date") -> str:
        return f"year({day}) = {y} AND quarter({day}) = {n}"

    def month(y: int, n: int) -> str:
        return f"year(balance_date) = {y} AND month(balance_date) = {n}"

    spring, summer = "2001-03-31", "2001-06-30"
    asked = {
        "dev-01": (fees, "fact_transaction", f"{net} AND {quarter(2001, 1)}"),
        "dev-02": (fees, "fact_transaction", f"{gross} AND {year(2000)}"),
        "dev-03": (fees, by_product, f"{net} AND product_name IN ('Chequing', 'Savings') AND {year(1999)}"),
        "dev-04": (rows, "customer_ledger", quarter(2000, 1, "posting_date")),
        "dev-05": (rows, "customer_ledger", quarter(2000, 1)),
        "dev-06": (volume, "governed_ledger", quarter(2000, 3)),
        "dev-07": (rows, "dim_customer", "is_active AND region = 'ASIA'"),
        "dev-08": (rows, holders, "region = 'EUROPE'"),
        "dev-09": (rows, "dim_customer", "is_active AND region = 'EUROPE'"),
        "dev-10": (mean, "fact_daily_balance", "year(balance_date) = 2001 AND quarter(balance_date) = 2"),
        "dev-11": (total, "fact_daily_balance", f"balance_date = '{spring}'"),
        "dev-12": (mean, "fact_daily_balance", month(2001, 4)),
        "dev-13": (late, _standing(spring), "true"),
        "dev-14": (rows, _standing(spring), "dpd >= 60"),
        "dev-15": (rows, "owner JOIN dim_product USING (product_id)", "product_type = 'loan' AND write_off_flag"),
        "dev-16": (volume, "netted_ledger", year(1999)),
        "dev-17": ("count(DISTINCT transaction_id)", reversed_rows, year(1999)),
        "dev-18": (volume, "fact_transaction", year(2000)),
        "dev-19": (volume, "governed_ledger", year(1999)),
        "dev-20": (rows, "customer_ledger", year(1999)),
        "dev-21": (rows, "fact_transaction", year(2000)),
        "dev-22": (volume, by_home, f"branch_name = 'NATION_3' AND {year(2000)}"),
        "dev-23": (rows, by_place, f"branch_name = 'NATION_6' AND {year(2000)}"),
        "dev-24": (volume, by_home, f"branch_name = 'NATION_4' AND {year(2000)}"),
        "holdout-01": (fees, "fact_transaction", f"{net} AND {year(1999)}"),
        "holdout-02": (fees, "fact_transaction", f"{net} AND {year(2000)}"),
        "holdout-03": (fees, by_product, f"{net} AND product_name = 'Credit Card' AND {year(2000)}"),
        "holdout-04": (rows, "customer_ledger", quarter(2000, 4, "posting_date")),
        "holdout-05": (rows, "customer_ledger", quarter(2000, 4)),
        "holdout-06": (volume, "governed_ledger", quarter(2001, 2, "posting_date")),
        "holdout-07": (rows, "dim_customer", "is_active"),
        "holdout-08": (rows, holders, "true"),
        "holdout-09": (rows, "dim_customer", "is_active AND region = 'AMERICA'"),
        "holdout-10": (mean, "fact_daily_balance", month(2001, 6)),
        "holdout-11": (total, "fact_daily_balance", f"balance_date = '{summer}'"),
        "holdout-12": (mean, "fact_daily_balance", month(2001, 5)),
        "holdout-13": (late, _standing(summer), "true"),
        "holdout-14": (rows, _standing(summer), "dpd >= 60"),
        "holdout-15": (volume, "netted_ledger", year(2000)),
        "holdout-16": ("count(DISTINCT transaction_id)", reversed_rows, year(2000)),
        "holdout-17": (volume, "governed_ledger", year(2000)),
        "holdout-18": (rows, "customer_ledger", year(2000)),
        "holdout-19": (volume, by_home, f"branch_name = 'NATION_5' AND {year(2000)}"),
        "holdout-20": (rows, by_place, f"branch_name = 'NATION_2' AND {year(2000)}"),
    }
    return {
        k: f"SELECT '{k}' AS question_id, round(CAST({value} AS DOUBLE), 2) AS expected_result FROM {source} WHERE {condition}"
        for k, (value, source, condition) in asked.items()
    }


register(
    "golden_answers",
    lambda t: q.answers(t, QUESTIONS, AS_OF_DATES[:2]),
    " UNION ALL ".join(_golden_sql().values()),
)


def records(t: Tables) -> DataFrame:
    return q.question_records(t, QUESTIONS, AS_OF_DATES[:2])


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if not value else "'" + value.replace("'", "''") + "'"


# How each ambiguity is settled.
READINGS = {
    "gross_vs_net_revenue": "Net revenue leaves waived fees out; gross keeps them.",
    "posting_vs_transaction_date": "Customer activity goes by transaction date, the ledger by posting date.",
    "open_vs_active_account": "Active means a transaction in the trailing window; open means an open account.",
    "month_end_vs_avg_daily_balance": "An average is over every day; a month end is one day's snapshot.",
    "written_off_loans": "Delinquency is measured on the active book; write-offs have their own count.",
    "reversed_transactions": "Volume leaves both halves of a reversed pair out.",
    "internal_accounts": "Customer figures leave the bank's own accounts out.",
    "customer_vs_branch_location": "Branch performance goes by home branch, foot traffic by the transaction's branch.",
}


def _record_sql() -> str:
    """The answers come from SQL of their own; a record's text and statement are given, and its statement is run in the tests."""
    golden = _golden_sql()
    parts = []
    for question in QUESTIONS:
        source = f"({golden[question.id]})" if question.answerable else "(SELECT CAST(NULL AS DOUBLE) AS expected_result)"
        parts.append(
            f"SELECT '{question.id}' AS id, {_text(question.text)} AS question, {str(question.answerable).upper()} AS answerable, "
            f"{_text(question.tag)} AS ambiguity_tag, {_text(question.sql)} AS sql, "
            f"{_text(READINGS.get(question.tag))} AS business_definition, expected_result FROM {source}"
        )
    return " UNION ALL ".join(parts)


register("question_records_with_answers", records, _record_sql())
