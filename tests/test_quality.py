from collections import Counter

from checks.quality_queries import BROKEN_TESTS, broken
from ledgerline import with_models
from ledgerline.operators import quality
from ledgerline.operators.quality import ColumnTest
from ledgerline.sources import sinks
from ledgerline.sources.schemas import PRIMARY_KEYS


def test_all_declared_tests_are_there():
    assert Counter(t.kind for t in quality.ALL_TESTS) == {"not_null": 16, "unique": 14, "accepted_values": 6, "relationships": 15}
    assert all(ColumnTest(t, c, "unique") in quality.RAW_TESTS for t, c in PRIMARY_KEYS.items())


def test_clean_tables_pass(tables):
    assert [r for r in quality.run_tests(tables, quality.ALL_TESTS).collect() if r.failures] == []


def test_each_fault_is_found_once(tables):
    found = {(r.column_name, r.test): r.failures for r in quality.run_tests(broken(tables), BROKEN_TESTS).collect()}
    assert found == {
        ("account_id", "not_null"): 1,
        ("transaction_id", "not_null"): 0,
        ("transaction_id", "unique"): 1,
        ("account_id", "relationships"): 1,
        ("transaction_type", "accepted_values"): 1,
    }


def test_null_passes_accepted_values_and_relationships(spark, tables):
    odd = spark.createDataFrame([(1, None), (2, "x"), (2, "open")], "k long, s string")
    t = tables.extend({"odd": lambda _: odd})
    tests = [ColumnTest("odd", "s", "accepted_values", ("open",)), ColumnTest("odd", "k", "unique"), ColumnTest("odd", "s", "unique"), ColumnTest("odd", "s", "not_null")]
    found = {(r.column_name, r.test): r.failures for r in quality.run_tests(t, tests).collect()}
    assert found == {("s", "accepted_values"): 1, ("k", "unique"): 1, ("s", "unique"): 0, ("s", "not_null"): 1}


def test_empty_table_passes(spark, tables):
    t = tables.extend({"none": lambda _: spark.createDataFrame([], "k long")})
    found = quality.run_tests(t, [ColumnTest("none", "k", "unique"), ColumnTest("none", "k", "not_null")]).collect()
    assert [r.failures for r in found] == [0, 0]


def test_invariants_hold(tables):
    assert all(r.holds for r in quality.invariants(tables).collect())


def test_values_may_hold_quotes(spark, tables):
    odd = spark.createDataFrame([("L'Orignal",), ("x",), (None,)], "`it's` string")
    report = quality.run_tests(tables.extend({"o'dd": lambda _: odd}), [ColumnTest("o'dd", "it's", "accepted_values", ("L'Orignal",)), ColumnTest("o'dd", "it's", "not_null"), ColumnTest("o'dd", "it's", "unique")])
    assert {r.test: r.failures for r in report.collect()} == {"accepted_values": 1, "not_null": 1, "unique": 0}


def test_a_table_is_scanned_once(spark, tables, tmp_path):
    stored = sinks.create_raw(tables, str(tmp_path / "raw"))
    staged = with_models(stored)
    for names, tests in ((["fact_transaction"], quality.RAW_TESTS), (["stg_accounts"], quality.STAGING_TESTS)):
        own = [t for t in tests if t.table in names]
        assert len({t.kind for t in own}) == 4
        df = quality.run_tests(staged, own)
        plan = df._jdf.queryExecution().executedPlan().toString()
        tested = "fact_transaction" if names == ["fact_transaction"] else "dim_account"
        assert sum("FileScan" in line and f"/{tested}" in line for line in plan.splitlines()) == 1
        assert "Generate" in plan and "NestedLoop" not in plan
        assert [r.failures for r in df.collect()] == [0] * len(own)


def test_all_faults_of_several_keys_in_one_scan(spark, tables):
    rows = [(1, 10, "a", 100), (2, 11, "b", None), (2, 99, "a", 101), (None, None, None, 7), (5, 99, "zz", 7)]
    child = spark.createDataFrame(rows, "k long, p int, s string, q long")
    parents = {"one": spark.createDataFrame([(10,), (11,), (11,), (None,)], "id long"), "two": spark.createDataFrame([(100,), (101,)], "id long")}
    mine = tables.extend({"child": lambda _: child, **{n: (lambda df: lambda _: df)(df) for n, df in parents.items()}})
    tests = [
        ColumnTest("child", "s", "not_null"), ColumnTest("child", "k", "unique"), ColumnTest("child", "p", "relationships", (), "one", "id"),
        ColumnTest("child", "q", "relationships", (), "two", "id"), ColumnTest("child", "q", "unique"), ColumnTest("child", "s", "accepted_values", ("a", "b")),
        ColumnTest("child", "k", "not_null"),
    ]
    found = {(r.column_name, r.test): r.failures for r in quality.run_tests(mine, tests).collect()}
    assert found == {
        ("s", "not_null"): 1, ("k", "unique"): 1, ("p", "relationships"): 2, ("q", "relationships"): 2, ("q", "unique"): 1,
        ("s", "accepted_values"): 1, ("k", "not_null"): 1,
    }
    none = mine.extend({"child": lambda _: child.where("false")})
    assert [r.failures for r in quality.run_tests(none, tests).collect()] == [0] * 7
