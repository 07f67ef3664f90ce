"""Column tests over each layer, a deliberately broken ledger, invariants, and access roles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import register, scratch
from ledgerline import Tables
from ledgerline.operators import quality, security
from ledgerline.operators.joins import orphans
from ledgerline.operators.quality import ColumnTest
from ledgerline.plans import metrics as m
from ledgerline.plans.models import marts
from ledgerline.sources.sinks import save_as_tables

BRANCH, REGION = "NATION_7", "ASIA"
MODEL_TABLE = {
    "stg_branches": "dim_branch", "stg_products": "dim_product", "stg_customers": "dim_customer",
    "stg_accounts": "dim_account", "stg_dates": "dim_date", "stg_daily_balances": "fact_daily_balance",
    "stg_loan_payments": "fact_loan_payment", "stg_interest": "fact_interest_monthly",
}


def _test_sql(t: ColumnTest, names: dict[str, str] = {}) -> str:
    table = names.get(t.table, MODEL_TABLE.get(t.table, t.table))
    if t.kind == "not_null":
        failures = f"SELECT count(*) FROM {table} WHERE {t.column} IS NULL"
    elif t.kind == "unique":
        failures = f"SELECT count(*) FROM (SELECT {t.column} FROM {table} WHERE {t.column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
    elif t.kind == "accepted_values":
        values = ", ".join(f"'{v}'" for v in t.values)
        failures = f"SELECT count(*) FROM {table} WHERE {t.column} NOT IN ({values})"
    else:
        parent = MODEL_TABLE.get(t.parent, t.parent)
        failures = f"""SELECT count(*) FROM {table} ch WHERE {t.column} IS NOT NULL
                       AND NOT EXISTS (SELECT 1 FROM {parent} pa WHERE pa.{t.parent_column} = ch.{t.column})"""
    return f"SELECT '{t.table}' AS table_name, '{t.column}' AS column_name, '{t.kind}' AS test, ({failures}) AS failures"


def _sql(tests: list[ColumnTest], names: dict[str, str] = {}) -> str:
    return " UNION ALL ".join(_test_sql(t, names) for t in tests)


for _layer, _tests in (
    ("raw", quality.RAW_TESTS),
    ("staging", quality.STAGING_TESTS),
    ("intermediate", quality.INTERMEDIATE_TESTS),
    ("marts", quality.MART_TESTS),
):
    register(f"quality_of_{_layer}", lambda t, tests=_tests: quality.run_tests(t, tests), _sql(_tests), whole="failures")


def broken(t: Tables) -> Tables:
    """The ledger with one repeated id, one missing account, one unknown account and one unknown type."""
    rows = t.ref("fact_transaction")
    first = rows.groupBy().agg(F.min("transaction_id").alias("transaction_id"))
    one = rows.join(first, "transaction_id", "left_semi").select(*rows.columns)
    faults = (
        one.unionByName(one.withColumns({"transaction_id": F.lit(-1).cast("long"), "account_id": F.lit(None).cast("long")}))
        .unionByName(one.withColumns({"transaction_id": F.lit(-2).cast("long"), "account_id": F.lit(-2).cast("long")}))
        .unionByName(one.withColumns({"transaction_id": F.lit(-3).cast("long"), "transaction_type": F.lit("transfer")}))
    )
    return t.extend({"fact_transaction": lambda _: rows.unionByName(faults)})


BROKEN_TESTS = [
    ColumnTest("fact_transaction", "account_id", "not_null"),
    *[x for x in quality.RAW_TESTS if x.table == "fact_transaction"],
]
BROKEN_LEDGER = {
    "broken_ledger": """
        SELECT * FROM fact_transaction UNION ALL
        SELECT * FROM fact_transaction WHERE transaction_id = (SELECT min(transaction_id) FROM fact_transaction) UNION ALL
        SELECT * REPLACE (-1 AS transaction_id, NULL AS account_id) FROM fact_transaction WHERE transaction_id = (SELECT min(transaction_id) FROM fact_transaction) UNION ALL
        SELECT * REPLACE (-2 AS transaction_id, -2 AS account_id) FROM fact_transaction WHERE transaction_id = (SELECT min(transaction_id) FROM fact_transaction) UNION ALL
        SELECT * REPLACE (-3 AS transaction_id, 'transfer' AS transaction_type) FROM fact_transaction WHERE transaction_id = (SELECT min(transaction_id) FROM fact_transaction)"""
}
register(
    "quality_of_broken_ledger",
    lambda t: quality.run_tests(broken(t), BROKEN_TESTS),
    _sql(BROKEN_TESTS, {"fact_transaction": "broken_ledger"}),
    whole="failures",
    extra=BROKEN_LEDGER,
)
register(
    "quality_failing_rows_of_broken_ledger",
    lambda t: orphans(broken(t).ref("fact_transaction"), "account_id", t.ref("dim_account"), "account_id")
    .select(F.lit("account_id").alias("problem"), F.col("_key").cast("string").alias("found"), "rows")
    .unionByName(
        quality.repeated_values(broken(t).ref("fact_transaction"), "transaction_id").select(
            F.lit("repeated").alias("problem"), F.col("transaction_id").cast("string").alias("found"), "rows"
        )
    )
    .unionByName(
        quality.unaccepted_values(broken(t).ref("fact_transaction"), "transaction_type", quality.TRANSACTION_TYPES).select(
            F.lit("type").alias("problem"), F.col("transaction_type").alias("found"), "rows"
        )
    )
    .unionByName(
        quality.null_rows(broken(t).ref("fact_transaction"), "account_id").select(
            F.lit("no account").alias("problem"), F.col("transaction_id").cast("string").alias("found"), F.lit(1).cast("long").alias("rows")
        )
    ),
    """SELECT 'account_id' AS problem, CAST(account_id AS VARCHAR) AS found, count(*) AS rows FROM broken_ledger
       WHERE account_id IS NOT NULL AND account_id NOT IN (SELECT account_id FROM dim_account) GROUP BY account_id
       UNION ALL SELECT 'repeated', CAST(transaction_id AS VARCHAR), count(*) FROM broken_ledger GROUP BY transaction_id HAVING count(*) > 1
       UNION ALL SELECT 'type', transaction_type, count(*) FROM broken_ledger WHERE transaction_type NOT IN ('fee', 'deposit', 'withdrawal', 'purchase') GROUP BY transaction_type
       UNION ALL SELECT 'no account', CAST(transaction_id AS VARCHAR), 1 FROM broken_ledger WHERE account_id IS NULL""",
    whole="rows",
    extra=BROKEN_LEDGER,
)
register(
    "quality_given_orders",
    lambda t: orphans(t.ref("fact_transaction"), "branch_id", t.ref("dim_branch"), "branch_id").agg(
        F.count(F.lit(1)).alias("unknown_branches")
    ),
    "SELECT count(DISTINCT branch_id) AS unknown_branches FROM fact_transaction WHERE branch_id NOT IN (SELECT branch_id FROM dim_branch)",
)
register(
    "quality_invariants",
    quality.invariants,
    """SELECT 'gross_fee_revenue_exceeds_net' AS check_name,
              -sum(amount) > -sum(CASE WHEN fee_waived = FALSE THEN amount END) AS holds
       FROM fact_transaction WHERE transaction_type = 'fee' AND is_reversal = FALSE
       UNION ALL SELECT 'open_differs_from_active',
              (SELECT count(DISTINCT c.customer_id) FROM dim_customer c JOIN dim_account a ON a.customer_id = c.customer_id WHERE a.status = 'open')
              <> (SELECT count(*) FROM dim_customer WHERE is_active = TRUE)
       UNION ALL SELECT 'dim_branch_has_rows', (SELECT count(*) FROM dim_branch) > 0
       UNION ALL SELECT 'dim_customer_has_rows', (SELECT count(*) FROM dim_customer) > 0
       UNION ALL SELECT 'fact_transaction_has_rows', (SELECT count(*) FROM fact_transaction) > 0""",
)

# ------------------------------------------------------------------ access roles

ALLOWED = {
    "National Analyst": "SELECT * FROM dim_customers",
    "Retail Analyst": "SELECT * FROM dim_customers",
    "Branch Manager": f"SELECT * FROM dim_customers WHERE home_branch_name = '{BRANCH}'",
    "Restricted User": f"SELECT * FROM dim_customers WHERE region = '{REGION}'",
}
FACT_CASTS = {
    "fct_transactions": ("*", dict(real="amount", dates="transaction_date, posting_date")),
    "fct_account_balances_monthly": ("* REPLACE (round(avg_daily_balance, 6) AS avg_daily_balance)", dict(real="month_end_balance", dates="month_start")),
    "fct_loans_monthly": ("*", dict(whole="days_past_due", dates="month_start")),
    "fct_interest_monthly": ("*", dict(real="interest_income, interest_expense, outstanding_loan_balance", dates="month_start")),
}


def role_tables(t: Tables, role: str) -> Tables:
    return security.for_role(marts(t), security.standard_roles(BRANCH, REGION)[role])


def _role_fact(role: str, fact: str):
    def run(t: Tables) -> DataFrame:
        df = role_tables(t, role).ref(fact)
        return df.withColumn("avg_daily_balance", F.round("avg_daily_balance", 6)) if "avg_daily_balance" in df.columns else df

    return run


for _role, _allowed in ALLOWED.items():
    _slug = _role.lower().replace(" ", "_")
    _hides = _role in ("Retail Analyst", "Restricted User")
    _columns = "* EXCLUDE (customer_name)" if _hides else "*"
    register(
        f"role_{_slug}_dim_customers",
        lambda t, role=_role: role_tables(t, role).ref("dim_customers"),
        f"SELECT {_columns} FROM ({_allowed})",
        dates="signup_date",
    )
    register(
        f"role_{_slug}_active_customers",
        lambda t, role=_role: m.query(role_tables(t, role), ["active_customer_count", "customer_count"]),
        f"""SELECT count(DISTINCT CASE WHEN is_active THEN customer_id END) AS active_customer_count,
                   count(DISTINCT customer_id) AS customer_count FROM ({_allowed})""",
    )
    for _fact, (_select, _casts) in FACT_CASTS.items():
        if _role in ("National Analyst",) or _hides and _fact in security.CREDIT_TABLES or _role == "Retail Analyst":
            continue
        register(
            f"role_{_slug}_{_fact}",
            _role_fact(_role, _fact),
            f"SELECT {_select} FROM {_fact} WHERE customer_id IN (SELECT customer_id FROM ({_allowed}))",
            **_casts,
        )


def role_through_sql(t: Tables) -> DataFrame:
    """Plain SQL in a restricted role's own session, after someone unrestricted made views in this one."""
    marts(t).create_views()
    return role_tables(t, "Restricted User").own_session().sql(
        """SELECT c.home_branch_name, count(*) AS transactions, CAST(sum(abs(f.amount)) AS double) AS volume
           FROM fct_transactions f JOIN dim_customers c ON f.customer_id = c.customer_id
           GROUP BY c.home_branch_name"""
    )


register(
    "role_restricted_user_through_sql",
    role_through_sql,
    f"""SELECT c.home_branch_name, count(*) AS transactions, sum(abs(f.amount)) AS volume
        FROM fct_transactions f JOIN dim_customers c ON f.customer_id = c.customer_id
        WHERE c.region = '{REGION}' GROUP BY 1""",
    real="volume",
)


def saved_marts(t: Tables) -> str:
    """The marts as tables of a new database that every session sees, with the reader's entitlements beside them."""
    database = f"marts_{uuid.uuid4().hex[:12]}"
    t.spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch(t.spark, database)}'")
    reader = t.ref("dim_branch").select(
        F.when(F.col("branch_id") % 5 == 0, F.expr("session_user()")).otherwise("someone else").alias("identity"),
        F.col("branch_name").alias("home_branch_name"),
    )
    save_as_tables(marts(t).extend({"entitlements": lambda _: reader}), [*marts(t).names(), "entitlements"], database)
    return database


def through_stored_views(role: security.Role | None, query: str):
    """A query in the session of a role whose tables are stored views; without a role, of whoever reads."""

    def run(t: Tables) -> DataFrame:
        saved = saved_marts(t)
        views = f"views_{saved}"
        mine = role or security.Role("By person", security.entitled_by(f"{saved}.entitlements"))
        security.save_role_views(t.spark, saved, views, mine, marts(t).names())
        return security.role_session(t.spark, views).sql(query)

    return run


register(
    "role_views_restricted_user",
    through_stored_views(
        security.standard_roles(BRANCH, REGION)["Restricted User"],
        """SELECT c.*, coalesce(f.transactions, 0) AS transactions
           FROM dim_customers c LEFT JOIN (SELECT customer_id, count(*) AS transactions FROM fct_transactions GROUP BY 1) f ON f.customer_id = c.customer_id""",
    ),
    f"""SELECT c.* EXCLUDE (customer_name), coalesce(n, 0) AS transactions
        FROM dim_customers c LEFT JOIN (SELECT customer_id, count(*) AS n FROM fct_transactions GROUP BY 1) f ON f.customer_id = c.customer_id
        WHERE region = '{REGION}'""",
    dates="signup_date",
    whole="transactions",
)
register(
    "role_views_by_the_readers_entitlements",
    through_stored_views(
        None,
        """SELECT c.home_branch_name, count(DISTINCT l.loan_account_id) AS loans, max(l.days_past_due) AS days_past_due
           FROM fct_loans_monthly l JOIN dim_customers c ON c.customer_id = l.customer_id GROUP BY 1""",
    ),
    """SELECT c.home_branch_name, count(DISTINCT l.loan_account_id) AS loans, max(l.days_past_due) AS days_past_due
       FROM fct_loans_monthly l JOIN dim_customers c ON c.customer_id = l.customer_id
       WHERE c.home_branch_id % 5 = 0 GROUP BY 1""",
    whole="loans, days_past_due",
)


def by_identity(t: Tables) -> DataFrame:
    """Entitlements derived from the branches: each region's analyst may see the region's branches."""
    bridge = t.ref("dim_branch").select(F.concat(F.lower("region"), F.lit("@bank")).alias("identity"), F.col("branch_name").alias("home_branch_name"))
    mine = security.for_identity(marts(t), bridge, "europe@bank")
    return m.query(mine, ["transaction_volume", "transaction_count"], by=["customer__home_branch_name"])


register(
    "role_by_identity_bridge",
    by_identity,
    """SELECT c.home_branch_name AS customer__home_branch_name, sum(abs(f.amount)) AS transaction_volume, count(*) AS transaction_count
       FROM fct_transactions f JOIN dim_customers c ON f.customer_id = c.customer_id WHERE c.region = 'EUROPE' GROUP BY 1""",
    real="transaction_volume",
)


def report_names(t: Tables) -> DataFrame:
    named = security.with_report_names(role_tables(t, "Restricted User"))
    return named.ref("fct_transactions").groupBy("Transaction Type").agg(F.count(F.lit(1)).alias("Transactions"))


register(
    "role_with_report_column_names",
    report_names,
    f"""SELECT transaction_type AS "Transaction Type", count(*) AS "Transactions" FROM fct_transactions
        WHERE customer_id IN (SELECT customer_id FROM dim_customers WHERE region = '{REGION}') GROUP BY 1""",
)
