"""Every registered query against its SQL, and what all their plans have in common."""

import pytest

import __spark_entry__ as contract
from checks.compare import difference
from checks.registry import ORACLES, QUERIES
from conftest import FOLDER

WRITES = {"sketch_transacting_customers_by_year", "sketch_transacting_accounts_by_quarter", "sketch_loans_by_month", "role_views_restricted_user", "role_views_by_the_readers_entitlements", "batches_appended_once_by_key", "late_postings_and_reversals_in_the_mart", "marts_after_batches_by_month", "catalog_tables_bucketed_and_queried", "result_log_written_and_read", "marts_written_and_queried", "raw_rows_created_and_appended"}


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    assert name in ORACLES
    assert difference(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql_without_broadcasts(spark, duck, name, no_broadcast):
    df = QUERIES[name](spark, FOLDER)
    assert difference(df, duck, ORACLES[name]) is None
    if name not in WRITES:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def jobs_of(spark, group: str) -> list[str]:
    """What the jobs of a group ran, apart from reading the schema of a file."""
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(i) for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds]
    return [stage.name for stage in stages if not stage.name.startswith("parquet at")]


def test_planning_starts_no_job(spark):
    from checks import registry

    registry._BANKS.clear()  # tables are planned again by the first query that needs them
    for name in sorted(set(QUERIES) - WRITES):
        spark.sparkContext.setJobGroup(f"plan {name}", name)
        QUERIES[name](spark, FOLDER)
        assert (name, jobs_of(spark, f"plan {name}")) == (name, [])
    spark.sparkContext.setJobGroup("tests", "tests")


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0




@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_plan_has_no_cross_join_window_or_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window ", "Python", "ExistingRDD"):
        if node == "Window " and name.startswith("report_"):
            continue  # report measures put a group's total beside its parts: a window over grouped rows
        # the question set itself is a short list on the driver; everything else comes from files
        assert node not in plan or (node == "ExistingRDD" and name == "question_records_with_answers")
