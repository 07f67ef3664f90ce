"""An answer log derived from the ledger: per customer, several questions, answered by four
configurations in three runs with the right reading, a naive reading, refusals and faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import Tables
from ledgerline.functions.calendar import Period
from ledgerline.operators.joins import sums_through_key
from ledgerline.plans.models import reversed_ids

# The published names of the four configurations.
CONFIGS = ["1_raw", "2_raw_glossary", "3_governed", "4_governed_ai_prep"]


def answer_log(t: Tables) -> DataFrame:
    reversed_once = (
        reversed_ids(t).where("reversal_of_transaction_id IS NOT NULL")
        .select(F.col("reversal_of_transaction_id").alias("transaction_id")).distinct()
        .withColumn("_reversed", F.lit(True))
    )
    rows = t.ref("fact_transaction").join(reversed_once, "transaction_id", "left")
    fee = "transaction_type = 'fee' AND NOT is_reversal"
    quarter = Period.quarter(2000, 1)
    within = f">= date'{quarter.start}' AND {{0}} < date'{quarter.end}'"
    sums = {
        "raw_volume": "sum(abs(amount))",
        "net_volume": "sum(CASE WHEN NOT is_reversal AND _reversed IS NULL THEN abs(amount) ELSE 0 END)",
        "gross_fees": f"sum(CASE WHEN {fee} THEN -amount ELSE 0 END)",
        "net_fees": f"sum(CASE WHEN {fee} AND NOT fee_waived THEN -amount ELSE 0 END)",
        "posted": f"count_if(posting_date {within.format('posting_date')})",
        "initiated": f"count_if(transaction_date {within.format('transaction_date')})",
    }
    owners = t.ref("dim_account").where(F.col("customer_id").isNotNull()).select("account_id", "customer_id")
    totals = [F.expr(f"{sql} AS {name}") for name, sql in sums.items()]
    facts = sums_through_key(rows, owners, "account_id", [], totals, ["customer_id"])

    def question(template: str, tag: str, answerable: str, right: str, naive: str) -> str:
        return (
            f"named_struct('template', '{template}', 'ambiguity_tag', {tag}, 'answerable', {answerable}, "
            f"'expected', CAST({right} AS double), 'naive', CAST({naive} AS double))"
        )

    asked = ", ".join(
        [
            question("volume", "'reversed_transactions'", "true", "net_volume", "raw_volume"),
            question("fees", "'gross_vs_net_revenue'", "true", "net_fees", "gross_fees"),
            question("posted", "'posting_vs_transaction_date'", "true", "posted", "initiated"),
            question("share", "CAST(NULL AS string)", "true", "net_volume", "gross_fees"),
            question("churn", "CAST(NULL AS string)", "false", "NULL", "initiated"),
        ]
    )
    configs = ", ".join(f"named_struct('config_no', {i}, 'config', '{c}')" for i, c in enumerate(CONFIGS))
    silent = "(refused OR execution_error <> '')"
    return (
        facts.selectExpr("customer_id", f"inline(array({asked}))")
        .selectExpr("*", f"inline(array({configs}))")
        .selectExpr("*", "explode(array(1, 2, 3)) AS run")
        .selectExpr("*", "(customer_id * 7 + run * 3 + length(template) + config_no * 5) % 20 AS h")
        .selectExpr("*", "CASE WHEN answerable THEN h = 1 ELSE h <> 3 END AS refused")
        .selectExpr("*", "CASE WHEN NOT refused AND h = 2 THEN 'Binder Error' ELSE '' END AS execution_error")
        .selectExpr(
            "config",
            "(CASE WHEN customer_id % 2 = 0 THEN 'dev' ELSE 'holdout' END) || (CASE WHEN answerable THEN '_in' ELSE '_oos' END) AS question_set",
            "run",
            "template || '-' || customer_id AS question_id",
            "customer_id AS question_order",
            "answerable",
            "ambiguity_tag",
            "refused",
            "execution_error",
            f"CASE WHEN {silent} THEN 0 WHEN h = 4 THEN 3 ELSE 1 END AS n_rows",
            f"CASE WHEN {silent} THEN 0 WHEN h = 5 THEN 2 ELSE 1 END AS n_cols",
            f"""CASE WHEN {silent} OR h = 6 THEN NULL WHEN config_no = 0 THEN naive WHEN config_no = 1 THEN coalesce(expected, naive)
                     WHEN config_no = 2 THEN -coalesce(expected, naive) WHEN h BETWEEN 7 AND 9 THEN naive
                     ELSE coalesce(expected, naive) * 1.005D END AS value""",
            "expected",
        )
    )


ANSWER_LOG = {
    "answer_facts": """
        SELECT a.customer_id,
               CAST(sum(abs(t.amount)) AS DOUBLE) AS raw_volume,
               CAST(sum(CASE WHEN NOT t.is_reversal AND t.transaction_id NOT IN (SELECT transaction_id FROM undone) THEN abs(t.amount) ELSE 0 END) AS DOUBLE) AS net_volume,
               CAST(sum(CASE WHEN t.transaction_type = 'fee' AND NOT t.is_reversal THEN -t.amount ELSE 0 END) AS DOUBLE) AS gross_fees,
               CAST(sum(CASE WHEN t.transaction_type = 'fee' AND NOT t.is_reversal AND NOT t.fee_waived THEN -t.amount ELSE 0 END) AS DOUBLE) AS net_fees,
               CAST(count(CASE WHEN t.posting_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31' THEN 1 END) AS DOUBLE) AS posted,
               CAST(count(CASE WHEN t.transaction_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31' THEN 1 END) AS DOUBLE) AS initiated
        FROM fact_transaction t JOIN dim_account a ON t.account_id = a.account_id
        WHERE a.customer_id IS NOT NULL GROUP BY a.customer_id""",
    "answer_questions": """
        SELECT customer_id, 'volume' AS template, 'reversed_transactions' AS ambiguity_tag, TRUE AS answerable, net_volume AS expected, raw_volume AS naive FROM answer_facts
        UNION ALL SELECT customer_id, 'fees', 'gross_vs_net_revenue', TRUE, net_fees, gross_fees FROM answer_facts
        UNION ALL SELECT customer_id, 'posted', 'posting_vs_transaction_date', TRUE, posted, initiated FROM answer_facts
        UNION ALL SELECT customer_id, 'share', NULL, TRUE, net_volume, gross_fees FROM answer_facts
        UNION ALL SELECT customer_id, 'churn', NULL, FALSE, NULL, initiated FROM answer_facts""",
    "answer_draws": """
        SELECT *, CASE WHEN answerable THEN h = 1 ELSE h <> 3 END AS refused FROM (
            SELECT a.*, c.config_no, c.config, r.run, (a.customer_id * 7 + r.run * 3 + length(a.template) + c.config_no * 5) % 20 AS h
            FROM answer_questions a
                 CROSS JOIN (VALUES (0, '1_raw'), (1, '2_raw_glossary'), (2, '3_governed'), (3, '4_governed_ai_prep')) c(config_no, config)
                 CROSS JOIN (VALUES (1), (2), (3)) r(run))""",
    "answer_log": """
        SELECT config, CASE WHEN customer_id % 2 = 0 THEN 'dev' ELSE 'holdout' END || CASE WHEN answerable THEN '_in' ELSE '_oos' END AS question_set,
               run, template || '-' || customer_id AS question_id, customer_id AS question_order, answerable, ambiguity_tag, refused,
               CASE WHEN NOT refused AND h = 2 THEN 'Binder Error' ELSE '' END AS execution_error,
               CASE WHEN refused OR h = 2 THEN 0 WHEN h = 4 THEN 3 ELSE 1 END AS n_rows,
               CASE WHEN refused OR h = 2 THEN 0 WHEN h = 5 THEN 2 ELSE 1 END AS n_cols,
               CASE WHEN refused OR h = 2 OR h = 6 THEN NULL
                    WHEN config_no = 0 THEN naive
                    WHEN config_no = 1 THEN coalesce(expected, naive)
                    WHEN config_no = 2 THEN -coalesce(expected, naive)
                    WHEN h BETWEEN 7 AND 9 THEN naive
                    ELSE coalesce(expected, naive) * CAST(1.005 AS DOUBLE) END AS value,
               expected
        FROM answer_draws""",
    "classified": """
        SELECT *, CASE
            WHEN NOT answerable AND refused THEN 'appropriate_refusal'
            WHEN NOT answerable THEN 'answered_unanswerable'
            WHEN refused THEN 'inappropriate_refusal'
            WHEN execution_error <> '' THEN 'invalid_sql'
            WHEN n_rows <> 1 OR n_cols <> 1 THEN 'wrong_grain'
            WHEN value IS NULL THEN 'wrong_filter'
            WHEN abs(value - expected) <= greatest(CAST(0.01 AS DOUBLE), abs(expected) * CAST(0.01 AS DOUBLE)) THEN 'correct'
            WHEN ambiguity_tag IN ('gross_vs_net_revenue', 'month_end_vs_avg_daily_balance') THEN 'wrong_metric'
            WHEN ambiguity_tag = 'posting_vs_transaction_date' THEN 'wrong_date'
            WHEN ambiguity_tag IN ('open_vs_active_account', 'written_off_loans', 'reversed_transactions', 'internal_accounts') THEN 'wrong_filter'
            WHEN ambiguity_tag = 'customer_vs_branch_location' THEN 'wrong_join'
            ELSE 'correct_looking_wrong_number' END AS failure_category
        FROM answer_log""",
}
