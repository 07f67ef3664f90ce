"""Scoring of an answer log, reading of answer texts and query plans, and stored results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.answer_log import ANSWER_LOG, CONFIGS, answer_log
from checks.registry import register, scratch
from ledgerline import Tables
from ledgerline.functions import answer_text
from ledgerline.plans import evaluation as e
from ledgerline.plans.models import GRAINS, marts
from ledgerline.plans.reference_questions import governed_volume
from ledgerline.sources import sinks
from ledgerline.sources.tables import from_catalog


def classified(t: Tables) -> DataFrame:
    return e.classify(answer_log(t))


register(
    "evaluation_outcomes",
    lambda t: classified(t).drop("question_order"),
    """SELECT * EXCLUDE (question_order),
              CASE WHEN failure_category NOT IN ('appropriate_refusal', 'inappropriate_refusal', 'invalid_sql', 'wrong_grain') THEN value END AS model_result
       FROM classified""",
    whole="run, n_rows, n_cols",
    extra=ANSWER_LOG,
)
register(
    "evaluation_summary",
    lambda t: e.summary(classified(t)),
    """SELECT config,
              round(avg(CASE WHEN question_set = 'dev_in' THEN CAST(failure_category = 'correct' AS DOUBLE) END), 4) AS dev_in_scope_accuracy,
              round(avg(CASE WHEN question_set = 'holdout_in' THEN CAST(failure_category = 'correct' AS DOUBLE) END), 4) AS holdout_in_scope_accuracy,
              round(avg(CASE WHEN question_set = 'holdout_oos' THEN CAST(failure_category = 'appropriate_refusal' AS DOUBLE) END), 4) AS holdout_out_of_scope_refusal_rate,
              count(CASE WHEN question_set = 'dev_in' THEN 1 END) AS n_dev_in_runs,
              count(CASE WHEN question_set = 'holdout_in' THEN 1 END) AS n_holdout_in_runs,
              count(CASE WHEN question_set = 'holdout_oos' THEN 1 END) AS n_holdout_oos_runs
       FROM classified GROUP BY config ORDER BY config""",
    extra=ANSWER_LOG,
)
register(
    "evaluation_accuracy_by_tag",
    lambda t: e.accuracy_by_tag(classified(t), CONFIGS),
    "SELECT ambiguity_tag, "
    + ", ".join(
        f"round(avg(CASE WHEN config = '{c}' THEN CAST(failure_category = 'correct' AS DOUBLE) END), 4) AS \"{c}\"" for c in CONFIGS
    )
    + " FROM classified WHERE answerable GROUP BY ambiguity_tag",
    extra=ANSWER_LOG,
)
register(
    "evaluation_run_variance",
    lambda t: e.run_variance(classified(t)),
    """SELECT config, round(100.0 * avg(CAST(n > 1 AS DOUBLE)), 1) AS variance_percent FROM (
         SELECT config, question_set, question_id, count(DISTINCT failure_category) AS n FROM classified GROUP BY 1, 2, 3) GROUP BY config""",
    real="variance_percent",
    extra=ANSWER_LOG,
)
register(
    "evaluation_failure_tally",
    lambda t: e.failure_tally(classified(t)),
    "SELECT config, failure_category, count(*) AS answers FROM classified GROUP BY 1, 2",
    extra=ANSWER_LOG,
)
register(
    "evaluation_configs",
    lambda t: e.configs_seen(classified(t)),
    "SELECT DISTINCT config FROM classified",
    extra=ANSWER_LOG,
)


def first_examples(t: Tables) -> DataFrame:
    questions = answer_log(t).select("ambiguity_tag", "question_order", "question_id", "expected").distinct()
    return e.first_per_tag(questions)


register(
    "evaluation_first_example_per_tag",
    first_examples,
    """SELECT ambiguity_tag, question_order, question_id, expected FROM (
         SELECT *, row_number() OVER (PARTITION BY ambiguity_tag ORDER BY question_order, question_id) AS rn
         FROM answer_log WHERE ambiguity_tag IS NOT NULL) WHERE rn = 1""",
    extra=ANSWER_LOG,
)


def question_sets(t: Tables) -> DataFrame:
    questions = answer_log(t).select("question_set", "question_id", "answerable").distinct()
    return e.question_table(questions.where("answerable"), questions.where("NOT answerable"))


register(
    "evaluation_question_sets",
    question_sets,
    "SELECT DISTINCT question_set, question_id, answerable FROM answer_log",
    extra=ANSWER_LOG,
)


# ------------------------------------------------------------------ answer texts and plans


def raw_answers(t: Tables) -> DataFrame:
    """Conversation turns dressed as raw answers: bare, fenced, refused."""
    text, kind = F.col("text"), (F.col("conv_id") + F.col("turn")) % 6
    dressed = (
        F.when(kind == 0, text)
        .when(kind == 1, F.concat(F.lit("```sql\n"), text, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit(" ```SQL"), text, F.lit("```  ")))
        .when(kind == 3, "CANNOT_ANSWER.")
        .when(kind == 4, "  cannot_answer \n")
        .otherwise("```\nCannot_Answer\n```")
    )
    return t.ref("conversations").select("conv_id", "turn", dressed.alias("answer"))


def normalised(t: Tables) -> DataFrame:
    sql, refused = answer_text.sql_or_refusal(F.col("answer"))
    return raw_answers(t).select(
        "conv_id", "turn", sql.alias("sql"), refused.alias("refused"), answer_text.single_line(sql).alias("one_line")
    )


_WS = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, '^{_WS}+|{_WS}+$', '', 'g')"


RAW_ANSWERS = {
    "raw_answers": """
        SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN text WHEN 1 THEN '```sql' || chr(10) || text || chr(10) || '```'
               WHEN 2 THEN ' ```SQL' || text || '```' || chr(160) || ' ' WHEN 3 THEN 'CANNOT_ANSWER.'
               WHEN 4 THEN '  cannot_answer ' || chr(10) ELSE '```' || chr(10) || 'Cannot_Answer' || chr(10) || '```' END AS answer
        FROM conversations""",
    "bodies": f"""
        SELECT conv_id, turn, CASE WHEN starts_with(s, '```')
               THEN {_strip("regexp_replace(regexp_replace(s, '^`+|`+$', '', 'g'), '^(?i)sql', '')")} ELSE s END AS body
        FROM (SELECT conv_id, turn, {_strip('answer')} AS s FROM raw_answers)""",
}
register(
    "answer_text_normalised",
    normalised,
    f"""SELECT conv_id, turn, CASE WHEN lower(body) IN ('cannot_answer', 'cannot_answer.') THEN NULL ELSE body END AS sql,
               lower(body) IN ('cannot_answer', 'cannot_answer.') AS refused,
               CASE WHEN lower(body) IN ('cannot_answer', 'cannot_answer.') THEN NULL
                    ELSE regexp_replace(body, '{_WS}+', ' ', 'g') END AS one_line
        FROM bodies""",
    extra=RAW_ANSWERS,
)


def query_plans(t: Tables) -> DataFrame:
    """One JSON query plan per event, most of them flawed in some way."""
    def plan(metric: Column, dimensions: Column, answerable: str | None) -> Column:
        last = f', "answerable": {answerable}' if answerable else ""
        return F.concat(
            F.lit('{"metric": '), metric, F.lit(', "dimensions": '), dimensions,
            F.lit(', "time_period": null, "filters": [], "ambiguities": []' + last + "}"),
        )

    metric = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    by = F.concat(F.lit('["user '), F.col("user_id").cast("string"), F.lit('"]'))
    good, kind = plan(metric, by, "true"), F.col("event_id") % 10
    text = (
        F.when(kind == 0, good)
        .when(kind == 1, plan(F.lit("null"), by, "false"))
        .when(kind == 2, plan(metric, by, None))
        .when(kind == 3, plan(metric, metric, "true"))
        .when(kind == 4, plan(metric, by, '"true"'))
        .when(kind == 5, F.concat(F.lit("["), good, F.lit("]")))
        .when(kind == 6, F.regexp_replace(good, "}$", ""))
        .when(kind == 7, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == 8, plan(F.lit("7"), by, "true"))
        .otherwise(F.col("props"))
    )
    return t.ref("events").select("event_id", text.alias("plan"))


def validated(t: Tables) -> DataFrame:
    problem = answer_text.plan_problem(F.col("plan"))
    return query_plans(t).select("event_id", problem.isNull().alias("valid"), problem.alias("reason"))


_FIELD = {"metric": "('VARCHAR', 'NULL')", "dimensions": "('ARRAY')", "time_period": "('VARCHAR', 'NULL')",
          "filters": "('ARRAY')", "ambiguities": "('ARRAY')", "answerable": "('BOOLEAN')"}
PLANS = {
    "good_plans": """
        SELECT *, '{"metric": "' || event_type || '", "dimensions": ["user ' || user_id || '"], "time_period": null, "filters": [], "ambiguities": [], "answerable": true}' AS good
        FROM events""",
    "plan_texts": """
        SELECT event_id, CASE event_id % 10 WHEN 0 THEN good
            WHEN 1 THEN '{"metric": null, "dimensions": ["user ' || user_id || '"], "time_period": null, "filters": [], "ambiguities": [], "answerable": false}'
            WHEN 2 THEN replace(good, ', "answerable": true', '')
            WHEN 3 THEN replace(good, '["user ' || user_id || '"]', '"' || event_type || '"')
            WHEN 4 THEN replace(good, '"answerable": true', '"answerable": "true"')
            WHEN 5 THEN '[' || good || ']'
            WHEN 6 THEN left(good, length(good) - 1)
            WHEN 7 THEN good
            WHEN 8 THEN replace(good, '"' || event_type || '"', '7')
            ELSE props END AS plan
        FROM good_plans""",
}
register(
    "query_plan_validation",
    validated,
    "SELECT event_id, reason IS NULL AS valid, reason FROM (SELECT event_id, CASE WHEN NOT json_valid(plan) THEN 'invalid_json' "
    "WHEN json_type(plan) <> 'OBJECT' THEN 'not_an_object' "
    + " ".join(
        f"WHEN json_type(plan, '$.{f}') IS NULL THEN 'missing:{f}' WHEN json_type(plan, '$.{f}') NOT IN {k} THEN 'wrong_type:{f}'"
        for f, k in _FIELD.items()
    )
    + " END AS reason FROM plan_texts)",
    extra=PLANS,
)


# ------------------------------------------------------------------ stored results


def stored_log(t: Tables) -> DataFrame:
    """The classified log written as CSV with a header and read back with its declared schema."""
    path = scratch(t.spark, "result-log")
    rows = classified(t).select(
        "config", "question_set", "run", "question_id", F.col("answerable").alias("answerable_expected"), "ambiguity_tag",
        F.lit('SELECT "a", b\nFROM t').alias("generated_sql"), "refused", "execution_error", "model_result",
        F.col("expected").alias("expected_result"), "failure_category",
    )
    sinks.write_result_log(rows, path)
    return sinks.read_result_log(t.spark, path).groupBy("config", "failure_category", "generated_sql").agg(
        F.count(F.lit(1)).alias("answers"), F.count("model_result").alias("values")
    )


register(
    "result_log_written_and_read",
    stored_log,
    """SELECT config, failure_category, 'SELECT "a", b FROM t' AS generated_sql, count(*) AS answers,
              count(CASE WHEN failure_category NOT IN ('appropriate_refusal', 'inappropriate_refusal', 'invalid_sql', 'wrong_grain') THEN value END) AS values
       FROM classified GROUP BY 1, 2""",
    extra=ANSWER_LOG,
)


def stored_marts(t: Tables) -> DataFrame:
    """Marts written once, split by month, and queried from their files."""
    stored = sinks.materialise(t, ["dim_customers", "fct_loans_monthly"], scratch(t.spark, "marts"), GRAINS)
    loans, customers = stored.ref("fct_loans_monthly"), stored.ref("dim_customers")
    return (
        loans.where(F.col("month_start") >= F.lit("2001-01-01").cast("date"))
        .join(customers, "customer_id")
        .groupBy("region", "month_start")
        .agg(F.count(F.lit(1)).alias("loans"))
    )


register(
    "marts_written_and_queried",
    stored_marts,
    """SELECT c.region, l.month_start, count(*) AS loans FROM fct_loans_monthly l JOIN dim_customers c ON l.customer_id = c.customer_id
       WHERE l.month_start >= DATE '2001-01-01' GROUP BY 1, 2""",
    dates="month_start",
)


def appended(t: Tables) -> DataFrame:
    """Loan payments created typed, then appended to, and read back with the declared schema."""
    path = scratch(t.spark, "raw")
    payments = t.ref("fact_loan_payment")
    late = F.col("days_past_due") > 0
    first = t.extend({"fact_loan_payment": lambda _: payments.where(~late)})
    stored = sinks.create_raw(first, path, ["fact_loan_payment"])
    sinks.append_rows(payments.where(late), path, "fact_loan_payment")
    return stored.ref("fact_loan_payment").groupBy("days_past_due").agg(
        F.count(F.lit(1)).alias("payments"), F.sum("payment_amount").alias("paid")
    )


register(
    "raw_rows_created_and_appended",
    appended,
    "SELECT days_past_due, count(*) AS payments, sum(payment_amount) AS paid FROM fact_loan_payment GROUP BY 1",
    whole="days_past_due",
    real="paid",
)
register(
    "imported_mart_in_memory",
    lambda t: marts(t).imported("fct_loans_monthly").ref("fct_loans_monthly").groupBy("write_off_flag", "days_past_due").agg(F.count(F.lit(1)).alias("n")),
    "SELECT write_off_flag, days_past_due, count(*) AS n FROM fct_loans_monthly GROUP BY 1, 2",
    whole="days_past_due",
)


def catalog_ledger(t: Tables) -> DataFrame:
    """The ledger stored in the session catalog in buckets by transaction id, and netted from there."""
    database = f"ledger_{uuid.uuid4().hex[:12]}"
    where = scratch(t.spark, database)
    t.spark.sql(f"CREATE DATABASE {database} LOCATION '{where}'")
    sinks.save_as_tables(t, ["fact_transaction", "dim_account"], database, {"fact_transaction": ("transaction_id", 8)})
    stored = from_catalog(t.spark, database, ["fact_transaction", "dim_account"])
    return governed_volume(stored, grain="year")


register(
    "catalog_tables_bucketed_and_queried",
    catalog_ledger,
    """SELECT CAST(date_trunc('year', transaction_date) AS DATE) AS period, sum(abs(amount)) AS volume
       FROM governed_ledger GROUP BY 1""",
    real="volume",
    dates="period",
)
