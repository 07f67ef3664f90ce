"""Batches applied once, whatever happens, and marts built again by month only."""

import os
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.compare import rows_of
from ledgerline import with_models
from ledgerline.operators.joins import FanOut
from ledgerline.plans.increments import Warehouse, changed_months
from ledgerline.plans.models import GRAINS, MARTS
from ledgerline.session import fresh_path
from ledgerline.sources import batches, sinks
from ledgerline.sources.folders import Folder
from ledgerline.sources.schemas import RAW
from ledgerline.sources.tables import from_parquet


def content(df):
    return rows_of(df.columns, df.collect())


def posting(key, day, reverses=None, account=1, amount="-5.00"):
    return (key, account, day, day, 3, "purchase", Decimal(amount), False, reverses is not None, reverses)


JAN, FEB, MAR = date(2024, 1, 10), date(2024, 2, 10), date(2024, 3, 10)
LEDGER = [posting(1, JAN), posting(2, JAN), posting(3, FEB), posting(4, FEB, amount="7.00"), posting(5, None)]


@pytest.fixture
def ledger(spark):
    return lambda rows: spark.createDataFrame(rows, RAW["fact_transaction"])


@pytest.fixture
def path(spark):
    return fresh_path(spark, "test-batches")


def keys(spark, path, name="fact_transaction"):
    return sorted(r[0] for r in from_parquet(spark, path).ref(name).select(RAW[name].names[0]).collect())


def files(root):
    return {os.path.join(folder, f): os.stat(os.path.join(folder, f)).st_mtime_ns for folder, _, names in os.walk(root) for f in names if f[0] not in "._"}


def test_a_batch_is_applied_once(spark, ledger, path):
    assert batches.append_batch(ledger(LEDGER[:2]), path, "fact_transaction", "a")
    before = files(path)
    assert not batches.append_batch(ledger(LEDGER), path, "fact_transaction", "a")
    assert files(path) == before and keys(spark, path) == [1, 2]
    assert batches.append_batch(ledger(LEDGER), path, "fact_transaction", "b")
    assert keys(spark, path) == [1, 2, 3, 4, 5] and before.items() <= files(path).items()
    assert sorted(r.transaction_id for r in batches.batch_rows(spark, path, "fact_transaction", "b").collect()) == [3, 4, 5]
    assert batches.applied(spark, path, "fact_transaction") == ["a", "b"]
    # a known key under another date is known all the same
    batches.append_batch(ledger([posting(1, MAR), posting(6, MAR)]), path, "fact_transaction", "c")
    assert keys(spark, path) == [1, 2, 3, 4, 5, 6]
    # nothing new, and nothing at all
    assert batches.append_batch(ledger(LEDGER), path, "fact_transaction", "d") and batches.append_batch(ledger([]), path, "fact_transaction", "e")
    assert keys(spark, path) == [1, 2, 3, 4, 5, 6] and batches.batch_rows(spark, path, "fact_transaction", "e").count() == 0


@pytest.mark.parametrize("rows, known", [([posting(1, FEB), posting(9, FEB)], "refuse"), ([posting(8, JAN), posting(8, FEB)], "skip"), ([posting(None, JAN)], "skip")])
def test_a_refused_batch_changes_nothing(spark, ledger, path, rows, known):
    batches.append_batch(ledger(LEDGER), path, "fact_transaction", "a")
    before = files(f"{path}/fact_transaction")
    with pytest.raises((batches.RepeatedKey, FanOut)):
        batches.append_batch(ledger(rows), path, "fact_transaction", "b", known)
    assert files(f"{path}/fact_transaction") == before and batches.applied(spark, path, "fact_transaction") == ["a"]
    assert batches.append_batch(ledger(LEDGER + [posting(7, FEB)]), path, "fact_transaction", "b")
    assert keys(spark, path) == [1, 2, 3, 4, 5, 7]


@pytest.mark.parametrize("name", ["fact_transaction", "fact_loan_payment", "dim_branch"])
def test_a_batch_broken_off_is_done_over(spark, path, monkeypatch, name):
    rows = {
        "fact_transaction": LEDGER,
        "fact_loan_payment": [(1, JAN, Decimal("5.00"), 0), (1, JAN, Decimal("5.00"), 0), (2, FEB, Decimal("6.00"), 30)],
        "dim_branch": [(i, "a", "b", "c") for i in range(40)],
    }[name]
    df = spark.createDataFrame(rows, RAW[name]).repartition(3)
    move, moved = Folder.move, []

    def fails(self, source, to):
        if moved:
            raise OSError("lost")
        moved.append(to)
        move(self, source, to)

    monkeypatch.setattr(Folder, "move", fails)
    with pytest.raises(OSError):
        batches.append_batch(df, path, name, "a")
    monkeypatch.setattr(Folder, "move", move)
    assert 0 < len(files(f"{path}/{name}")) and batches.applied(spark, path, name) == []
    assert batches.append_batch(df, path, name, "a") and not batches.append_batch(df, path, name, "a")
    assert content(from_parquet(spark, path).ref(name).select(*RAW[name].names)) == content(df)


def test_names_and_readings_are_checked(ledger, path):
    for name in ("a.b", "", "a/b", "a*"):
        with pytest.raises(ValueError):
            batches.append_batch(ledger(LEDGER), path, "fact_transaction", name)
    with pytest.raises(ValueError):
        batches.append_batch(ledger(LEDGER), path, "fact_transaction", "a", "overwrite")


def test_stored_keys_are_pruned_by_range(spark, ledger, path):
    batches.append_batch(ledger(LEDGER), path, "fact_transaction", "a")
    plan = batches.stored_keys(ledger([posting(3, MAR), posting(9, MAR)]), path, "fact_transaction", "transaction_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(transaction_id,3)" in plan and "LessThanOrEqual(transaction_id,9)" in plan
    assert "amount" not in plan[plan.index("ReadSchema"):]


def test_a_refused_mart_leaves_the_stored_one(spark, tables):
    path = fresh_path(spark, "test-kept")
    sinks.materialise(tables, ["dim_customers"], path, GRAINS)
    before = files(path)
    twice = tables.ref("dim_customers").union(tables.ref("dim_customers"))
    with pytest.raises(FanOut):
        sinks.materialise(tables.extend({"dim_customers": lambda _: twice}), ["dim_customers"], path, GRAINS)
    assert {f: t for f, t in files(path).items() if "_staged" not in f} == before


ACCOUNTS = [(1, 10, 1, 3, JAN, None, "open", False, False, None), (2, None, 6, 3, JAN, None, "open", True, False, None)]


@pytest.fixture
def store(spark, tables, ledger):
    """A warehouse of one account, with the dimensions of the test data."""
    raw = {name: spark.createDataFrame([], RAW[name]) for name in RAW}
    raw |= {name: tables.ref(name) for name in ("dim_date", "dim_branch", "dim_product")}
    raw["dim_customer"] = spark.createDataFrame([(10, "c", 3, "r", True, JAN)], RAW["dim_customer"])
    raw["dim_account"] = spark.createDataFrame(ACCOUNTS, RAW["dim_account"])
    raw["fact_transaction"] = ledger(LEDGER)
    raw["fact_loan_payment"] = spark.createDataFrame([(1, JAN, Decimal("5.00"), 0), (1, FEB, Decimal("5.00"), 30)], RAW["fact_loan_payment"])
    store = Warehouse(spark, fresh_path(spark, "test-raw"), fresh_path(spark, "test-marts"))
    store.load("base", tables.extend({name: (lambda df: lambda _: df)(df) for name, df in raw.items()}))
    return store


def same_as_a_full_build(store):
    full, stored = with_models(store.raw()), store.marts()
    for mart in MARTS:
        assert content(stored.ref(mart).select(*full.ref(mart).columns)) == content(full.ref(mart)), mart


def by_month(store, mart="fct_transactions"):
    return {f.split("=")[1].split("/")[0]: (f, t) for f, t in files(f"{store.marts_path}/{mart}").items() if "=" in f}


def test_only_changed_months_are_built_again(store, ledger):
    same_as_a_full_build(store)
    before = by_month(store)
    assert set(before) == {"2024-01-01", "2024-02-01", "__HIVE_DEFAULT_PARTITION__"}
    # a March reversal of a January posting, and a posting of March itself
    changed = store.apply("one", {"fact_transaction": ledger([posting(20, MAR, 1), posting(21, MAR)])})
    assert changed == {"fct_transactions": [date(2024, 1, 1), date(2024, 3, 1)]}
    same_as_a_full_build(store)
    after = by_month(store)
    assert after["2024-02-01"] == before["2024-02-01"] and after["2024-01-01"] != before["2024-01-01"]
    # the second reversal takes January's last row: its folder goes
    store.apply("two", {"fact_transaction": ledger([posting(22, MAR, 2)])})
    same_as_a_full_build(store)
    assert set(by_month(store)) == {"2024-02-01", "2024-03-01", "__HIVE_DEFAULT_PARTITION__"}
    # a reversal stored before its original, rows without a date, and a rerun
    rows = [posting(30, FEB, 31)]
    store.apply("three", {"fact_transaction": ledger(rows)})
    assert store.apply("four", {"fact_transaction": ledger([posting(31, JAN), posting(32, None)])}) == {"fct_transactions": [None, date(2024, 1, 1)]}
    same_as_a_full_build(store)
    before = files(store.marts_path)
    assert store.apply("four", {"fact_transaction": ledger([posting(99, JAN)])}) == {} and files(store.marts_path) == before


def test_a_run_that_ends_before_the_marts_is_taken_up(store, ledger, spark):
    rows = {"fact_transaction": ledger([posting(20, MAR, 1)]), "fact_loan_payment": spark.createDataFrame([(1, FEB, Decimal("1.00"), 60)], RAW["fact_loan_payment"])}
    for name, df in rows.items():  # the raw rows are in place, the marts are not
        batches.append_batch(df, store.raw_path, name, "late")
    assert store.apply("late", rows) == {"fct_transactions": [date(2024, 1, 1), date(2024, 3, 1)], "fct_loans_monthly": [date(2024, 2, 1)]}
    same_as_a_full_build(store)


def test_rows_of_a_dimension_build_all_again(store, spark):
    before = by_month(store)
    new = ACCOUNTS[0][:1] + (11,) + ACCOUNTS[0][2:]
    store.apply("accounts", {"dim_account": spark.createDataFrame([new, (3, 10, 3, 3, JAN, None, "open", False, True, FEB)], RAW["dim_account"])})
    assert keys(spark, store.raw_path, "dim_account") == [1, 2, 3] and by_month(store).keys() == before.keys()
    same_as_a_full_build(store)


def test_changed_months_reach_the_files(store, ledger):
    from ledgerline.plans.increments import in_months

    part = with_models(in_months(store.raw(), "fact_transaction", [date(2024, 1, 1)]))
    plan = part.ref("fct_transactions")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(transaction_date_month" in plan or "transaction_date_month#" in plan[plan.index("PartitionFilters"):].split("]")[0]
    # a reversal whose original is not stored changes its own month only
    assert changed_months(store.raw(), {"fact_transaction": ledger([posting(50, MAR, 777)])}) == {"fct_transactions": [date(2024, 3, 1)]}
