"""The banking tables and models as plain SQL over the generic order tables.

Each entry is the body of a common table expression; ``with_tables`` puts the ones a query names, and
whatever they rest on, in front of it.
"""

from __future__ import annotations

import re

# the as-of date is the day of the last order
AS_OF = "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"
FIRST_DAY = "(SELECT least(DATE '1995-01-01', min(CAST(o_orderdate AS DATE))) FROM orders)"
BALANCES = f"CAST(date_trunc('month', {AS_OF}) - INTERVAL 5 MONTH AS DATE)"

TABLES: dict[str, str] = {
    "dim_date": f"""
        SELECT d AS date_key, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
               CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day,
               d = last_day(d) AND month(d) IN (3, 6, 9, 12) AS is_quarter_end,
               d = last_day(d) AS is_month_end
        FROM (SELECT CAST(unnest(generate_series({FIRST_DAY}, {AS_OF}, INTERVAL 1 DAY)) AS DATE) AS d)""",
    "dim_branch": """
        SELECT CAST(n_nationkey AS BIGINT) AS branch_id, n_name AS branch_name, n_name AS city, r_name AS region
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "dim_product": """
        SELECT CAST(column0 AS BIGINT) AS product_id, column1 AS product_name, column2 AS product_type
        FROM (VALUES (1, 'Chequing', 'deposit'), (2, 'Savings', 'deposit'), (3, 'Personal Loan', 'loan'),
                     (4, 'Mortgage', 'loan'), (5, 'Credit Card', 'credit'), (6, 'Internal GL', 'internal')) v(column0, column1, column2)""",
    "dim_account": """
        SELECT c_custkey + 1 AS account_id, c_custkey AS customer_id,
               CAST(CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END AS BIGINT) AS product_id,
               CAST(c_nationkey AS BIGINT) AS home_branch_id,
               DATE '1995-01-01' + CAST(c_custkey % 365 + c_custkey % 30 AS INTEGER) AS open_date,
               CASE WHEN c_custkey % 20 = 0
                    THEN DATE '1995-03-02' + CAST(c_custkey % 365 + c_custkey % 470 AS INTEGER) END AS close_date,
               CASE WHEN c_custkey % 20 = 0 THEN 'closed' ELSE 'open' END AS status,
               FALSE AS is_internal, FALSE AS write_off_flag, CAST(NULL AS DATE) AS write_off_date
        FROM customer
        UNION ALL
        SELECT 1000000000000000 + c_custkey, c_custkey,
               CASE WHEN c_custkey % 8 = 0 THEN 3 ELSE 4 END, c_nationkey,
               DATE '1999-01-01' + CAST(c_custkey % 700 AS INTEGER), NULL,
               CASE WHEN c_custkey % 28 = 0 THEN 'closed' ELSE 'open' END, FALSE, c_custkey % 28 = 0,
               CASE WHEN c_custkey % 28 = 0 THEN DATE '2001-01-01' + CAST(c_custkey % 200 AS INTEGER) END
        FROM customer WHERE c_custkey % 4 = 0
        UNION ALL
        SELECT 2000000000000000 + s_suppkey, NULL, 6, 0, DATE '1995-01-01', NULL, 'open', TRUE, FALSE, NULL
        FROM supplier""",
    "originals": """
        SELECT o_orderkey AS transaction_id,
               CASE WHEN o_orderkey % 20 = 0 THEN 2000000000000000 + o_custkey % 10 ELSE o_custkey + 1 END AS account_id,
               CAST(o_orderdate AS DATE) AS transaction_date,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS posting_date,
               CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 25 WHEN o_orderkey % 20 = 0 THEN 0
                         ELSE c_nationkey END AS BIGINT) AS branch_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'fee' WHEN '2-HIGH' THEN 'deposit'
                    WHEN '3-MEDIUM' THEN 'withdrawal' ELSE 'purchase' END AS transaction_type,
               CAST(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(12, 2)) AS amount,
               o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 1 AS fee_waived
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fact_transaction": f"""
        SELECT *, FALSE AS is_reversal, CAST(NULL AS BIGINT) AS reversal_of_transaction_id FROM originals
        UNION ALL
        SELECT 1000000000000000 + transaction_id, account_id,
               transaction_date + CAST(1 + transaction_id % 5 AS INTEGER),
               transaction_date + CAST(1 + transaction_id % 5 + transaction_id % 4 AS INTEGER),
               branch_id, transaction_type, CAST(-amount AS DECIMAL(12, 2)), FALSE, TRUE, transaction_id
        FROM originals
        WHERE transaction_type <> 'fee' AND transaction_id % 33 = 0
          AND transaction_date + CAST(1 + transaction_id % 5 AS INTEGER) <= {AS_OF}""",
    "recently_seen": f"""
        SELECT DISTINCT customer_id FROM fact_transaction JOIN dim_account USING (account_id)
        WHERE transaction_date >= {AS_OF} - 90 AND customer_id IS NOT NULL""",
    "dim_customer": """
        SELECT c_custkey AS customer_id, c_name AS customer_name, branch_id AS home_branch_id, region,
               c_custkey IN (SELECT customer_id FROM recently_seen) AS is_active,
               DATE '1995-01-01' + CAST(c_custkey % 365 AS INTEGER) AS signup_date
        FROM customer JOIN dim_branch ON branch_id = c_nationkey""",
    "fact_daily_balance": f"""
        SELECT account_id, d AS balance_date,
               CAST(4850 + (account_id * 31 + day(d) * 17 + month(d) * 101) % 9001 AS DECIMAL(12, 2)) AS balance_amount
        FROM (SELECT account_id, CAST(unnest(generate_series({BALANCES}, {AS_OF}, INTERVAL 1 DAY)) AS DATE) AS d
              FROM dim_account WHERE product_id IN (1, 2) AND status = 'open')""",
    "loan_months": f"""
        SELECT account_id, product_name, write_off_flag, write_off_date, open_date, m AS month_start,
               (year(m) - year(open_date)) * 12 + month(m) - month(open_date) AS i
        FROM (SELECT a.*, p.product_name,
                     CAST(unnest(generate_series(CAST(date_trunc('month', open_date) AS DATE),
                                                 CASE WHEN write_off_flag THEN write_off_date ELSE {AS_OF} END,
                                                 INTERVAL 1 MONTH)) AS DATE) AS m
              FROM dim_account a JOIN dim_product p ON a.product_id = p.product_id
              WHERE p.product_type = 'loan')""",
    "fact_loan_payment": """
        SELECT account_id AS loan_account_id, month_start AS payment_date,
               CAST(200 + (account_id + month(month_start) * 37) % 1600 AS DECIMAL(12, 2)) AS payment_amount,
               CAST(CASE WHEN write_off_flag THEN
                         CASE (year(write_off_date) - year(month_start)) * 12 + month(write_off_date) - month(month_start)
                              WHEN 0 THEN 120 WHEN 1 THEN 90 WHEN 2 THEN 60 WHEN 3 THEN 30 WHEN 4 THEN 30 ELSE 0 END
                    WHEN (account_id + month(month_start)) % 13 = 0 THEN 30
                    WHEN (account_id + month(month_start)) % 17 = 0 THEN 60 ELSE 0 END AS INTEGER) AS days_past_due
        FROM loan_months""",
    "loan_balances": """
        SELECT account_id, month_start,
               CAST(round(CASE product_name WHEN 'Personal Loan' THEN CAST(5000 + account_id % 35001 AS DOUBLE) * greatest(0.0, 1.0 - CAST(i AS DOUBLE) / 60)
                          ELSE CAST(150000 + account_id % 350001 AS DOUBLE) * greatest(0.0, 1.0 - CAST(i AS DOUBLE) / 300) END, 2) AS DECIMAL(12, 2)) AS outstanding,
               CASE product_name WHEN 'Personal Loan' THEN CAST(0.0070 AS DECIMAL(6, 4)) ELSE CAST(0.0035 AS DECIMAL(6, 4)) END AS rate
        FROM loan_months""",
    "fact_interest_monthly": """
        SELECT b.account_id, CAST(date_trunc('month', b.balance_date) AS DATE) AS month_start,
               CAST(0 AS DECIMAL(12, 2)) AS interest_income,
               CAST(round(CAST(avg(CAST(b.balance_amount AS DOUBLE)) AS DECIMAL(18, 6))
                    * CASE p.product_name WHEN 'Chequing' THEN CAST(0.0002 AS DECIMAL(6, 4))
                           WHEN 'Savings' THEN CAST(0.0015 AS DECIMAL(6, 4)) ELSE CAST(0 AS DECIMAL(6, 4)) END, 2) AS DECIMAL(12, 2)) AS interest_expense,
               CAST(0 AS DECIMAL(12, 2)) AS outstanding_loan_balance
        FROM fact_daily_balance b JOIN dim_account a ON b.account_id = a.account_id
             JOIN dim_product p ON a.product_id = p.product_id
        GROUP BY b.account_id, date_trunc('month', b.balance_date), p.product_name
        UNION ALL
        SELECT account_id, month_start, CAST(round(outstanding * rate, 2) AS DECIMAL(12, 2)), 0, outstanding
        FROM loan_balances""",
    # the readings most queries are built on
    "customer_ledger": """
        SELECT t.* FROM fact_transaction t JOIN dim_account a ON t.account_id = a.account_id WHERE NOT a.is_internal""",
    "undone": """
        SELECT DISTINCT reversal_of_transaction_id AS transaction_id FROM fact_transaction
        WHERE reversal_of_transaction_id IS NOT NULL""",
    "netted_ledger": """
        SELECT * FROM fact_transaction WHERE NOT is_reversal AND transaction_id NOT IN (SELECT transaction_id FROM undone)""",
    "governed_ledger": """
        SELECT t.* FROM netted_ledger t JOIN dim_account a ON t.account_id = a.account_id WHERE NOT a.is_internal""",
    "stg_transactions": """
        SELECT transaction_id, account_id, transaction_date, posting_date, branch_id, transaction_type, amount, fee_waived
        FROM governed_ledger""",
    "int_account_balances_monthly": """
        SELECT account_id, CAST(date_trunc('month', balance_date) AS DATE) AS month_start,
               avg(CAST(balance_amount AS DOUBLE)) AS avg_daily_balance,
               max(balance_amount) FILTER (balance_date = last_day(balance_date)) AS month_end_balance
        FROM fact_daily_balance GROUP BY ALL""",
    "int_loan_delinquency_monthly": """
        SELECT loan_account_id, CAST(date_trunc('month', payment_date) AS DATE) AS month_start,
               arg_max(days_past_due, (payment_date, days_past_due)) AS days_past_due
        FROM fact_loan_payment GROUP BY ALL""",
    "owner": "SELECT account_id, customer_id, product_id, home_branch_id, write_off_flag FROM dim_account",
    "dim_customers": """
        SELECT c.customer_id, c.customer_name, c.is_active, c.signup_date, c.home_branch_id,
               b.branch_name AS home_branch_name, b.region
        FROM dim_customer c JOIN dim_branch b ON b.branch_id = c.home_branch_id""",
    "fct_transactions": """
        SELECT g.transaction_id, g.account_id, g.transaction_date, g.posting_date, g.transaction_type, g.amount, g.fee_waived,
               o.customer_id, o.product_id,
               here.branch_id AS transaction_branch_id, here.branch_name AS transaction_branch_name, here.region AS transaction_region,
               home.branch_id AS home_branch_id, home.branch_name AS home_branch_name, home.region AS home_region
        FROM stg_transactions g JOIN owner o ON o.account_id = g.account_id
             JOIN dim_branch here ON here.branch_id = g.branch_id
             JOIN dim_branch home ON home.branch_id = o.home_branch_id""",
    "fct_account_balances_monthly": """
        SELECT account_id, customer_id, product_id, month_start, avg_daily_balance, month_end_balance
        FROM int_account_balances_monthly JOIN owner USING (account_id)""",
    "fct_loans_monthly": """
        SELECT loan_account_id, month_start, days_past_due, customer_id, product_id, write_off_flag
        FROM int_loan_delinquency_monthly d JOIN owner ON account_id = loan_account_id""",
    "fct_interest_monthly": """
        SELECT account_id, month_start, interest_income, interest_expense, outstanding_loan_balance, customer_id, product_id
        FROM fact_interest_monthly JOIN owner USING (account_id)""",
}


def with_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """The query with the tables it names defined in front of it."""
    bodies = {**TABLES, **(extra or {})}
    needed: set[str] = set()
    queue = [sql]
    while queue:
        words = set(re.findall(r"[a-z_0-9]+", queue.pop()))
        for name in bodies:
            if name in words and name not in needed:
                needed.add(name)
                queue.append(bodies[name])
    if not needed:
        return sql
    ordered = [name for name in bodies if name in needed]
    return "WITH " + ",\n".join(f"{name} AS ({bodies[name]})" for name in ordered) + "\n" + sql
