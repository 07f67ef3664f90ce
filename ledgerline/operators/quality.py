"""Declarative column tests, run with few passes, each reporting how many rows or values fail."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.tables import Tables


@dataclass(frozen=True)
class ColumnTest:
    table: str
    column: str
    kind: str                          # not_null | unique | accepted_values | relationships
    values: tuple[str, ...] = ()
    parent: str = ""
    parent_column: str = ""


def _key(table: str, column: str) -> list[ColumnTest]:
    return [ColumnTest(table, column, "not_null"), ColumnTest(table, column, "unique")]


def _accepted(table: str, column: str, *values: str) -> ColumnTest:
    return ColumnTest(table, column, "accepted_values", values)


def _refers(table: str, column: str, parent: str, parent_column: str) -> ColumnTest:
    return ColumnTest(table, column, "relationships", (), parent, parent_column)


# The lists the columns may take.
PRODUCT_TYPES = ("deposit", "loan", "credit", "internal")
STATUSES = ("open", "closed")
TRANSACTION_TYPES = ("fee", "deposit", "withdrawal", "purchase")

RAW_TESTS = [
    *_key("dim_date", "date_key"),
    *_key("dim_branch", "branch_id"),
    *_key("dim_product", "product_id"),
    _accepted("dim_product", "product_type", *PRODUCT_TYPES),
    *_key("dim_customer", "customer_id"),
    *_key("dim_account", "account_id"),
    _accepted("dim_account", "status", *STATUSES),
    *_key("fact_transaction", "transaction_id"),
    _refers("fact_transaction", "account_id", "dim_account", "account_id"),
    _accepted("fact_transaction", "transaction_type", *TRANSACTION_TYPES),
    _refers("fact_daily_balance", "account_id", "dim_account", "account_id"),
    _refers("fact_loan_payment", "loan_account_id", "dim_account", "account_id"),
    _refers("fact_interest_monthly", "account_id", "dim_account", "account_id"),
]
STAGING_TESTS = [
    *_key("stg_branches", "branch_id"),
    *_key("stg_products", "product_id"),
    _accepted("stg_products", "product_type", *PRODUCT_TYPES),
    *_key("stg_customers", "customer_id"),
    *_key("stg_accounts", "account_id"),
    _refers("stg_accounts", "customer_id", "stg_customers", "customer_id"),
    _refers("stg_accounts", "product_id", "stg_products", "product_id"),
    _accepted("stg_accounts", "status", *STATUSES),
    *_key("stg_dates", "date_key"),
    *_key("stg_transactions", "transaction_id"),
    _refers("stg_transactions", "account_id", "stg_accounts", "account_id"),
    _accepted("stg_transactions", "transaction_type", *TRANSACTION_TYPES),
    _refers("stg_daily_balances", "account_id", "stg_accounts", "account_id"),
    _refers("stg_loan_payments", "loan_account_id", "stg_accounts", "account_id"),
    _refers("stg_interest", "account_id", "stg_accounts", "account_id"),
]
INTERMEDIATE_TESTS = [
    _refers("int_account_balances_monthly", "account_id", "stg_accounts", "account_id"),
    ColumnTest("int_account_balances_monthly", "month_start", "not_null"),
    _refers("int_loan_delinquency_monthly", "loan_account_id", "stg_accounts", "account_id"),
    ColumnTest("int_loan_delinquency_monthly", "month_start", "not_null"),
]
MART_TESTS = [
    *_key("dim_customers", "customer_id"),
    *_key("fct_transactions", "transaction_id"),
    _refers("fct_account_balances_monthly", "account_id", "stg_accounts", "account_id"),
    _refers("fct_loans_monthly", "loan_account_id", "stg_accounts", "account_id"),
    _refers("fct_interest_monthly", "account_id", "stg_accounts", "account_id"),
]
ALL_TESTS = [*RAW_TESTS, *STAGING_TESTS, *INTERMEDIATE_TESTS, *MART_TESTS]


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def unaccepted_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.where(~F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def _report(counts: DataFrame, tests: Sequence[ColumnTest]) -> DataFrame:
    """One row per test from a single row whose columns are the tests' counts."""
    rows = [
        F.struct(
            F.lit(t.table).alias("table_name"), F.lit(t.column).alias("column_name"), F.lit(t.kind).alias("test"),
            F.coalesce(F.col(f"_{i}"), F.lit(0).cast("long")).alias("failures"),
        )
        for i, t in enumerate(tests)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _is_bad(test: ColumnTest) -> Column:
    column = _column(test.column)
    return column.isNull() if test.kind == "not_null" else ~column.isin(*test.values)


def _row_tests(df: DataFrame, tests: Sequence[ColumnTest]) -> DataFrame:
    """All null and accepted-value checks of a table in one aggregate."""
    return _report(df.agg(*[F.count_if(_is_bad(t)).alias(f"_{i}") for i, t in enumerate(tests)]), tests)


def _keyed_tests(df: DataFrame, key: str, tests: Sequence[ColumnTest]) -> DataFrame:
    """The uniqueness of a key and the table's row checks in one pass, grouped by that key.

    Rows are counted per key before the shuffle, so a value that repeats a lot travels once per task.
    """
    others = {i: t for i, t in enumerate(tests) if t.kind != "unique"}
    per_key = df.groupBy(_column(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(_is_bad(t)).alias(f"_{i}") for i, t in others.items()]
    )
    repeated = F.count_if((F.col("_rows") > 1) & F.col("_key").isNotNull())
    return _report(
        per_key.agg(*[(F.sum(f"_{i}") if i in others else repeated).alias(f"_{i}") for i in range(len(tests))]), tests
    )


def _all_keys(tables: Tables, df: DataFrame, tests: Sequence[ColumnTest]) -> DataFrame:
    """All tests of a table in one scan of it.

    A row gives one small row for each key that is unique or refers to a parent, tagged with its test; these are counted per key in the tasks and
    once more after one shuffle, where the keys of all parents, tagged alike, meet them in one join. Checks of single rows ride on the first key.
    """
    keys = [i for i, t in enumerate(tests) if t.kind in ("unique", "relationships")]
    singles = [i for i, t in enumerate(tests) if t.kind not in ("unique", "relationships")]
    kinds = {df.schema[tests[i].column].dataType.simpleString() for i in keys}
    kind = "bigint" if kinds <= {"bigint", "int", "smallint", "tinyint"} else kinds.pop() if len(kinds) == 1 else "string"
    tagged = F.array(*[
        F.struct(
            F.lit(i).alias("_test"), _column(tests[i].column).cast(kind).alias("_key"),
            *[(_is_bad(tests[j]) if i == keys[0] else F.lit(None).cast("boolean")).alias(f"_bad{j}") for j in singles],
        )
        for i in keys
    ])
    per_key = df.select(F.inline(tagged)).groupBy("_test", "_key").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(f"_bad{j}").alias(f"_{j}") for j in singles]
    )
    parents = [
        tables.ref(tests[i].parent).select(F.lit(i).alias("_test"), _column(tests[i].parent_column).cast(kind).alias("_key"))
        for i in keys if tests[i].kind == "relationships"
    ]
    if parents:
        known = reduce(DataFrame.union, parents).where("_key IS NOT NULL").distinct().withColumn("_known", F.lit(True))
        per_key = per_key.join(known, ["_test", "_key"], "left")
    mine = lambda i: (F.col("_test") == i) & F.col("_key").isNotNull()
    counts = []
    for i, t in enumerate(tests):
        if t.kind == "unique":
            counts.append(F.count_if(mine(i) & (F.col("_rows") > 1)))
        elif t.kind == "relationships":
            counts.append(F.sum(F.when(mine(i) & F.col("_known").isNull(), F.col("_rows"))))
        else:
            counts.append(F.sum(f"_{i}"))
    return _report(per_key.agg(*[c.alias(f"_{i}") for i, c in enumerate(counts)]), tests)


def run_tests(tables: Tables, tests: Sequence[ColumnTest]) -> DataFrame:
    """One row per test with its failures: rows for not_null, accepted_values and relationships,
    repeated values for unique. Every tested table is scanned once, and a parent once more for each table that refers to it."""
    parts = []
    for table in dict.fromkeys(t.table for t in tests):
        df = tables.ref(table)
        own = [t for t in tests if t.table == table]
        unique = [t for t in own if t.kind == "unique"]
        if any(t.kind == "relationships" for t in own) or len(unique) > 1:
            parts.append(_all_keys(tables, df, own))
        elif unique:
            parts.append(_keyed_tests(df, unique[0].column, own))
        else:
            parts.append(_row_tests(df, own))
    return reduce(DataFrame.union, parts)


def invariants(tables: Tables) -> DataFrame:
    """Counts and orderings that hold on any sound warehouse, one row per check."""
    t = tables.ref("fact_transaction").where((F.col("transaction_type") == "fee") & ~F.col("is_reversal"))
    fees = t.agg(
        (-F.sum("amount")).alias("gross"), (-F.sum(F.when(~F.col("fee_waived"), F.col("amount")))).alias("net")
    ).select(F.lit("gross_fee_revenue_exceeds_net").alias("check_name"), (F.col("gross") > F.col("net")).alias("holds"))
    open_owners = (
        tables.ref("dim_account").where((F.col("status") == "open") & F.col("customer_id").isNotNull())
        .select("customer_id").distinct().withColumn("_open", F.lit(1))
    )
    differ = (
        tables.ref("dim_customer").join(open_owners, "customer_id", "left")
        .agg(F.count("_open").alias("open"), F.count(F.when(F.col("is_active"), 1)).alias("active"))
        .select(F.lit("open_differs_from_active").alias("check_name"), (F.col("open") != F.col("active")).alias("holds"))
    )
    filled = [
        tables.ref(name).agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(f"{name}_has_rows").alias("check_name"), (F.col("n") > 0).alias("holds"))
        for name in ("dim_branch", "dim_customer", "fact_transaction")
    ]
    result = fees.unionByName(differ)
    for part in filled:
        result = result.unionByName(part)
    return result
