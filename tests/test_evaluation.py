import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import answer_text
from ledgerline.plans import evaluation as e

LOG = (
    "config string, question_set string, run int, question_id string, answerable boolean, ambiguity_tag string, "
    "refused boolean, execution_error string, n_rows int, n_cols int, value double, expected double"
)


def answer(spark, answerable=True, tag=None, refused=False, error=None, n_rows=1, n_cols=1, value=None, expected=None):
    row = ("c", "dev_in", 1, "q", answerable, tag, refused, error, n_rows, n_cols, value, expected)
    got = e.classify(spark.createDataFrame([row], LOG)).first()
    return got.failure_category, got.model_result


@pytest.mark.parametrize(
    "given_, outcome",
    [
        (dict(answerable=False, refused=True, n_rows=None, n_cols=None), ("appropriate_refusal", None)),
        (dict(answerable=False, value=3.0), ("answered_unanswerable", 3.0)),
        (dict(refused=True, error="x"), ("inappropriate_refusal", None)),
        (dict(error="x", n_rows=None), ("invalid_sql", None)),
        (dict(n_rows=None, n_cols=None), ("wrong_grain", None)),
        (dict(n_rows=2, value=1.0, expected=1.0), ("wrong_grain", None)),
        (dict(n_cols=2, value=1.0, expected=1.0), ("wrong_grain", None)),
        (dict(expected=1.0, tag="internal_accounts"), ("wrong_filter", None)),
        (dict(value=101.0, expected=100.0), ("correct", 101.0)),
        (dict(value=-101.0, expected=-100.0), ("correct", -101.0)),
        (dict(value=0.01, expected=0.0), ("correct", 0.01)),
        (dict(value=0.011, expected=0.0), ("correct_looking_wrong_number", 0.011)),
        (dict(value=101.1, expected=100.0, tag="posting_vs_transaction_date"), ("wrong_date", 101.1)),
        (dict(value=-100.0, expected=100.0, tag="gross_vs_net_revenue"), ("wrong_metric", -100.0)),
        (dict(value=0.0, expected=100.0, tag="customer_vs_branch_location"), ("wrong_join", 0.0)),
        (dict(value=0.0, expected=100.0, tag="unheard_of"), ("correct_looking_wrong_number", 0.0)),
    ],
)
def test_outcome_rules_in_order(spark, given_, outcome):
    assert answer(spark, **given_) == outcome


def _scored(config, question_set, n, good, category="correct", other="wrong_filter"):
    return [(config, question_set, i % 3 + 1, f"{question_set}-{i // 3}", question_set.endswith("in"), "internal_accounts", category if i < good else other) for i in range(n)]


def test_summary_reproduces_published_shares(spark):
    shares = {"1_raw": (23, 20), "2_raw_glossary": (50, 42), "3_governed": (19, 14), "4_governed_ai_prep": (36, 29)}
    rows = []
    for config, (dev, held) in shares.items():
        rows += _scored(config, "dev_in", 72, dev) + _scored(config, "holdout_in", 60, held)
        rows += _scored(config, "holdout_oos", 24, 24, "appropriate_refusal")
    log = spark.createDataFrame(rows, "config string, question_set string, run int, question_id string, answerable boolean, ambiguity_tag string, failure_category string")
    assert [tuple(r) for r in e.summary(log).collect()] == [
        ("1_raw", 0.3194, 0.3333, 1.0, 72, 60, 24),
        ("2_raw_glossary", 0.6944, 0.7, 1.0, 72, 60, 24),
        ("3_governed", 0.2639, 0.2333, 1.0, 72, 60, 24),
        ("4_governed_ai_prep", 0.5, 0.4833, 1.0, 72, 60, 24),
    ]
    tally = {(r.config, r.failure_category): r.answers for r in e.failure_tally(log).collect()}
    assert tally["1_raw", "correct"] == 43 and tally["1_raw", "appropriate_refusal"] == 24


def test_variance_counts_questions_whose_runs_disagree(spark):
    rows = [("c", "dev_in", f"q{q}", "correct" if q or run else "wrong_filter") for q in range(4) for run in range(3)]
    log = spark.createDataFrame(rows, "config string, question_set string, question_id string, failure_category string")
    assert e.run_variance(log).first().variance_percent == 25.0


def test_every_outcome_has_a_place_in_the_list():
    named = set(re.findall(r"THEN '([a-z_]+)'|ELSE '([a-z_]+)'", e.outcome_sql()))
    assert {a or b for a, b in named} == set(e.OUTCOMES)


def _read(text):
    """What a reader of answers does with one text, in plain Python."""
    body = text.strip()
    if body.startswith("```"):
        body = body.strip("`")
        body = (body[3:] if body[:3].lower() == "sql" else body).strip()
    return (None, True) if body.lower().rstrip() in ("cannot_answer", "cannot_answer.") else (body, False)


PIECES = st.sampled_from(["```", "`", "sql", "SQL", " ", "\n", "\t", " ", " ", "\x1c", "SELECT 1", "CANNOT_ANSWER", "cannot_answer", ".", "é", "\x0b"])


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=8).map("".join), min_size=1, max_size=60))
def test_answer_texts_equal_plain_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    sql, refused = answer_text.sql_or_refusal(F.col("t"))
    got = [(r[1], r[2]) for r in df.select("i", sql, refused).orderBy("i").collect()]
    assert got == [_read(t) for t in texts]


def test_single_line(spark):
    df = spark.createDataFrame([("  SELECT\n   1,\t2  ",)], "t string")
    assert df.select(answer_text.single_line(F.col("t"))).first()[0] == "SELECT 1, 2"


# A sample plan and published shares.
VALID = {"metric": "delinquency_rate", "dimensions": ["branch"], "time_period": "previous_quarter", "filters": ["x"], "ambiguities": [], "answerable": True}


@pytest.mark.parametrize(
    "plan, problem",
    [
        (json.dumps(VALID), None),
        (json.dumps({**VALID, "metric": None, "time_period": None}), None),
        (json.dumps({k: v for k, v in VALID.items() if k != "answerable"}), "missing:answerable"),
        (json.dumps({**VALID, "dimensions": "branch"}), "wrong_type:dimensions"),
        (json.dumps({**VALID, "answerable": "true"}), "wrong_type:answerable"),
        (json.dumps({**VALID, "answerable": 1}), "wrong_type:answerable"),
        (json.dumps({**VALID, "metric": 1}), "wrong_type:metric"),
        (json.dumps({**VALID, "metric": {"a": 1}}), "wrong_type:metric"),
        (json.dumps({**VALID, "filters": None}), "wrong_type:filters"),
        (json.dumps({**VALID, "extra": 1}), None),
        (json.dumps(["not", "a", "dict"]), "not_an_object"),
        ('"text"', "not_an_object"),
        ("{", "invalid_json"),
        ("", "invalid_json"),
        ("```json\n" + json.dumps(VALID) + "\n```", None),
        ("```\n" + json.dumps(VALID) + "```", None),
    ],
)
def test_plan_checks(spark, plan, problem):
    df = spark.createDataFrame([(plan,)], "p string")
    assert df.select(answer_text.plan_problem(F.col("p"))).first()[0] == problem


def test_first_per_tag(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), (None, 0, "w"), ("", 0, "v")], "ambiguity_tag string, question_order int, question_id string")
    assert sorted(tuple(r) for r in e.first_per_tag(df).collect()) == [("a", 1, "y"), ("b", 5, "z")]
