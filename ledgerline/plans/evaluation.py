"""Scoring of logged answers against expected values.

The log has one row per answer: config, question_set, run, question_id, answerable, ambiguity_tag,
refused, execution_error, n_rows, n_cols, value, expected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The failure each ambiguity is blamed on.
CATEGORY_OF_TAG = {
    "gross_vs_net_revenue": "wrong_metric",
    "posting_vs_transaction_date": "wrong_date",
    "open_vs_active_account": "wrong_filter",
    "month_end_vs_avg_daily_balance": "wrong_metric",
    "written_off_loans": "wrong_filter",
    "reversed_transactions": "wrong_filter",
    "internal_accounts": "wrong_filter",
    "customer_vs_branch_location": "wrong_join",
}
OTHER_CATEGORY = "correct_looking_wrong_number"
OUTCOMES = [
    "appropriate_refusal",
    "answered_unanswerable",
    "inappropriate_refusal",
    "invalid_sql",
    "wrong_grain",
    "correct",
    *sorted({*CATEGORY_OF_TAG.values(), OTHER_CATEGORY}),
]


# within a cent or one percent, whichever is wider
CLOSE = "abs(value - expected) <= greatest(0.01D, abs(expected) * 0.01D)"


def outcome_sql() -> str:
    """The outcome of an answer, by the first rule that applies."""
    blame = " ".join(f"WHEN '{tag}' THEN '{category}'" for tag, category in CATEGORY_OF_TAG.items())
    return f"""CASE
        WHEN NOT answerable AND refused THEN 'appropriate_refusal'
        WHEN NOT answerable THEN 'answered_unanswerable'
        WHEN refused THEN 'inappropriate_refusal'
        WHEN coalesce(execution_error, '') <> '' THEN 'invalid_sql'
        WHEN NOT coalesce(n_rows = 1 AND n_cols = 1, false) THEN 'wrong_grain'
        WHEN value IS NULL THEN 'wrong_filter'
        WHEN {CLOSE} THEN 'correct'
        ELSE CASE ambiguity_tag {blame} ELSE '{OTHER_CATEGORY}' END END"""


def classify(log: DataFrame) -> DataFrame:
    """The log with its outcome, and the value kept only where the outcome rests on one."""
    no_value = "'appropriate_refusal', 'inappropriate_refusal', 'invalid_sql', 'wrong_grain'"
    return log.selectExpr("*", f"{outcome_sql()} AS failure_category").selectExpr(
        "*", f"CASE WHEN failure_category NOT IN ({no_value}) THEN value END AS model_result"
    )


def _share(condition: Column, among: Column) -> Column:
    return F.round(F.avg(F.when(among, condition.cast("double"))), 4)


def summary(classified: DataFrame) -> DataFrame:
    in_set = {s: F.col("question_set") == s for s in ("dev_in", "holdout_in", "holdout_oos")}
    correct = F.col("failure_category") == "correct"
    refused = F.col("failure_category") == "appropriate_refusal"
    return (
        classified.groupBy("config")
        .agg(
            _share(correct, in_set["dev_in"]).alias("dev_in_scope_accuracy"),
            _share(correct, in_set["holdout_in"]).alias("holdout_in_scope_accuracy"),
            _share(refused, in_set["holdout_oos"]).alias("holdout_out_of_scope_refusal_rate"),
            *[F.count(F.when(in_set[s], 1)).alias(f"n_{s}_runs") for s in in_set],
        )
        .orderBy("config")
    )


def accuracy_by_tag(classified: DataFrame, configs: Sequence[str]) -> DataFrame:
    correct = (F.col("failure_category") == "correct").cast("double")
    return (
        classified.where(F.col("answerable"))
        .groupBy("ambiguity_tag")
        .pivot("config", list(configs))
        .agg(F.round(F.avg(correct), 4))
    )


def run_variance(classified: DataFrame) -> DataFrame:
    """Percent of questions whose runs do not all end in the same category.

    Categories are compared by their place in the list: numbers keep this a hash aggregate.
    """
    category = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("failure_category"))
    per_question = classified.groupBy("config", "question_set", "question_id").agg(
        (F.min(category) != F.max(category)).cast("double").alias("differs")
    )
    return per_question.groupBy("config").agg(F.round(F.avg("differs") * 100, 1).alias("variance_percent"))


def failure_tally(classified: DataFrame) -> DataFrame:
    return classified.groupBy("config", "failure_category").agg(F.count(F.lit(1)).alias("answers"))


def configs_seen(classified: DataFrame) -> DataFrame:
    return classified.select("config").distinct()


def first_per_tag(questions: DataFrame, order: str = "question_order") -> DataFrame:
    """The first question of each tag. A minimum, so a tag that holds most questions stays one row per task."""
    columns = [c for c in questions.columns if c != "ambiguity_tag"]
    ordered = F.struct(order, *[c for c in columns if c != order])
    return (
        questions.where(F.coalesce("ambiguity_tag", F.lit("")) != "")
        .groupBy("ambiguity_tag")
        .agg(F.min(ordered).alias("first"))
        .select("ambiguity_tag", "first.*")
    )


def question_table(in_scope: DataFrame, out_of_scope: DataFrame) -> DataFrame:
    return in_scope.unionByName(out_of_scope)
