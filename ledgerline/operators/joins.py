"""Join forms shared by the models: lookups, anti joins, latest-as-of, fan-out guard."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(dim: DataFrame) -> DataFrame:
    """A side that grows with the bank (accounts, customers): its join shuffles both sides and spills, and is never broadcast.

    Spark takes a table for as large as its files, compressed and before any row is taken apart. By that it would broadcast, through the
    driver, millions of rows that stand in a few megabytes.
    """
    return dim.hint("merge")


def lookup(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Many-to-one equi-join of ``fact`` to a ``dim`` that is unique on ``key``.

    The plan is left to Spark, and no job runs while it is built: a dimension under the broadcast threshold leaves the fact
    where it lies, a larger one, or one given ``by_key``, meets it in a shuffle whose hot partitions, whether one key fills
    them or rows without a key, adaptive execution splits by their measured size at run time.
    """
    return fact.join(dim, key, how)


def sums_through_key(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    by: Sequence[Column],
    sums: Sequence[Column],
    dim_by: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Aggregates of ``fact`` grouped by ``by`` and by columns of ``dim``, which is unique on ``key``.

    The fact meets the dimension first, so it moves at most once and not at all while the dimension can be
    broadcast; the aggregates then combine in the tasks. A count over nothing is 0.
    """
    return lookup(fact, dim, key, how).groupBy(*by, *dim_by).agg(*sums)


def without(df: DataFrame, ids: DataFrame, key: str, id_column: str) -> DataFrame:
    """Rows whose key is not among ``ids``: NOT IN over non-null values.

    Written as a plain anti join so a large id set can shuffle; ids are made distinct first so a
    value repeated many times counts once.
    """
    distinct = ids.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(distinct, key, "left_anti")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key before each is taken apart into many.

    What a few files hold would otherwise be taken apart by as few tasks, and adaptive execution, which splits a large
    partition between the tasks that wrote it, could not split what one task wrote.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def status_code(when: Column, value: Column) -> Column:
    """Packs a date and an int (or NULL) into one long that sorts by date, then value.

    A plain ``max`` of it is a hash aggregate, where ``max_by`` or a window would sort every group.
    """
    slot = F.when(value.isNull(), F.lit(0)).otherwise(value.cast("long") + F.lit(2**31 + 1))
    return F.unix_date(when).cast("long") * F.lit(2**33) + slot


def status_value(code: Column) -> Column:
    slot = F.pmod(code, F.lit(2**33))
    return F.when(slot > 0, (slot - F.lit(2**31 + 1)).cast("int"))


def latest_sql(when: str, value: str) -> str:
    """The value of the last date as a SQL aggregate, by the same packing; of equal dates the largest value, NULL if it is NULL."""
    code = f"max(unix_date({when}) * {2**33}L + coalesce({value} + {2**31 + 1}L, 0L))"
    return f"(nullif(pmod({code}, {2**33}L), 0L) - {2**31 + 1}L)"


class FanOut(ValueError):
    """The join key is not unique on the one-side."""


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """Refuses a table that repeats its key. Runs a job, so it belongs where a table has just been written."""
    known = reduce(and_, [F.col(k).isNotNull() for k in key])
    if not df.where(known).groupBy(*key).count().where("count > 1").isEmpty():
        raise FanOut(f"{', '.join(key)} is not unique; aggregate to it before joining")
    return df


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Non-null child keys that have no parent, with how many child rows hold each.

    Keys are counted before the join, so a key that fills a third of the table is one row.
    """
    keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    known = parent.select(F.col(parent_key).alias("_key"), F.lit(True).alias("_known"))
    return keys.join(known, "_key", "left").where("_known IS NULL").drop("_known")
