from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.operators import joins


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def skewed(spark):
    """A third of 9,000 facts on one key, a tenth on another."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, 8).otherwise(F.col("id") % 1000 + 100)
    return spark.range(9000).select("id", key.cast("long").alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_is_planned_without_a_job(spark, skewed, how):
    dim = spark.range(50, 700).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.sparkContext.setJobGroup(f"lookup {how}", how)
    found = joins.lookup(skewed, dim, "k", how)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(f"lookup {how}")) == []
    spark.sparkContext.setJobGroup("tests", "tests")
    assert rows(found) == rows(skewed.join(dim, "k", how))


def test_a_hot_key_is_split_at_run_time(spark, no_broadcast):
    """Half of the rows on one key: adaptive execution reads that partition in several tasks."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        fact = spark.range(0, 400_000, 1, 16).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("long").alias("k"))
        dim = spark.range(0, 400_000, 1, 4).select(F.col("id").alias("k"), F.col("id").alias("v"))
        joined = joins.lookup(fact, dim, "k")
        assert joined.count() == 400_000
        joined.write.format("noop").mode("overwrite").save()
        done = joins.lookup(fact, dim, "k")
        done.collect()
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_without_is_not_in_over_non_null_values(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long")
    ids = spark.createDataFrame([(2,), (2,), (None,)], "r long")
    assert rows(joins.without(df, ids, "k", "r")) == [(1,), (3,)]


def test_sums_through_key_equals_join_then_sum(spark, skewed):
    dim = spark.range(0, 1200).select(F.col("id").alias("k"), (F.col("id") % 5).alias("g"))
    sums = [F.sum("id").alias("s"), F.count(F.lit(1)).alias("n")]
    fast = joins.sums_through_key(skewed, dim, "k", [(F.col("id") % 2).alias("b")], sums, ["g"])
    slow = skewed.withColumn("b", F.col("id") % 2).join(dim, "k").groupBy("b", "g").agg(*sums)
    assert rows(fast) == rows(slow)
    nothing = joins.sums_through_key(skewed.where("false"), dim, "k", [], sums).first()
    assert (nothing.s, nothing.n) == (None, 0)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.dates(date(1900, 1, 1), date(2100, 1, 1)), st.one_of(st.none(), st.integers(-5, 2**31 - 1))), min_size=1, max_size=30))
def test_latest_status_equals_brute_force(spark, payments):
    df = spark.createDataFrame(payments, "k int, d date, v int")
    code = F.max(joins.status_code(F.col("d"), F.col("v"))).alias("c")
    found = {r.k: r.v for r in df.groupBy("k").agg(code).select("k", joins.status_value(F.col("c")).alias("v")).collect()}
    expected = {}
    for k in {p[0] for p in payments}:
        expected[k] = max(((d, v is not None, v or 0), v) for kk, d, v in payments if kk == k)[1]
    assert found == expected


def test_orphans_counts_rows_per_missing_key(spark):
    child = spark.createDataFrame([(1,), (9,), (9,), (None,)], "c long")
    parent = spark.createDataFrame([(1,), (1,)], "p long")
    assert rows(joins.orphans(child, "c", parent, "p")) == [(9, 2)]


def test_require_unique_refuses_a_repeated_key(spark):
    ok = spark.range(3).withColumnRenamed("id", "k")
    assert joins.require_unique(ok, "k") is ok
    with pytest.raises(joins.FanOut):
        joins.require_unique(ok.union(ok), "k")
