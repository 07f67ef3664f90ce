"""Appends by key that can be run again.

A batch has a name. Its rows are written aside, held against the stored keys, and put in place file by file; a record of the batch is
written last. A batch with a record is not applied again. One that was broken off has a beginning but no record: what it
left in place is taken away before it starts anew, so it is applied once whatever happened.

One writer at a time appends to a table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.joins import require_unique
from ledgerline.sources.folders import Folder
from ledgerline.sources.schemas import PRIMARY_KEYS, RAW, STORED_BY
from ledgerline.sources.sinks import month_folder, typed, write_table
from ledgerline.sources.tables import read_stored


class RepeatedKey(ValueError):
    """A row of the batch has a key that is stored already, or none."""


def stored_keys(batch: DataFrame, path: str, name: str, key: str) -> DataFrame:
    """The stored keys that can meet those of a batch.

    A key may stand in any month, so all are looked at, but only its own column and, since the range of the batch's keys reaches the
    files, only row groups that overlap it. Ids are given out in order, so that is little.
    """
    first, last = batch.agg(F.min(key), F.max(key)).first()
    table = read_stored(batch.sparkSession, path, name, RAW[name])
    return table.where(F.col(key).between(first, last)).select(key)


def applied(spark, path: str, name: str) -> list[str]:
    """Batches of a table that are in place, by name."""
    return Folder(spark, path).children(f"_batches/{name}/done")


def append_batch(df: DataFrame, path: str, name: str, batch: str, known: str = "skip") -> bool:
    """Appends the rows of a named batch to a stored table; False if that batch is in place already.

    Of a table with a primary key, rows whose key is stored are left out (``known="skip"``) or the batch is refused (``known="refuse"``);
    a batch that repeats a key of its own, or lacks one, is refused in any case, and a refused batch leaves the table as it was. A table
    without a key takes every row of a batch, once.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"{batch!r} is no name for a batch")
    if known not in ("skip", "refuse"):
        raise ValueError(f"known keys are skipped or refused, not {known!r}")
    spark, folder, schema = df.sparkSession, Folder(df.sparkSession, path), RAW[name]
    begun, done, aside = (f"_batches/{name}/{state}/{batch}" for state in ("begun", "done", "staged"))
    if folder.exists(done):
        return False
    if folder.exists(begun):  # broken off
        for left in [*folder.matching(f"{name}/{batch}.*"), *folder.matching(f"{name}/*=*/{batch}.*")]:
            folder.remove(left)
    folder.remove(aside)
    write_table(typed(df, schema), folder.path(f"{aside}/given"), name)
    ready = "given"
    if name in PRIMARY_KEYS:
        key = PRIMARY_KEYS[name]
        rows = read_stored(spark, folder.path(f"{aside}/given"), name, schema)
        if not rows.where(F.col(key).isNull()).isEmpty():
            raise RepeatedKey(f"a row of batch {batch} has no {key}")
        require_unique(rows, key)
        if folder.children(name) and not rows.isEmpty():
            stored = stored_keys(rows, path, name, key)
            if not rows.join(stored, key, "left_semi").isEmpty():
                if known == "refuse":
                    raise RepeatedKey(f"a {key} of batch {batch} is stored in {name} already")
                ready = "new"
                write_table(rows.join(stored, key, "left_anti").select(*schema.names), folder.path(f"{aside}/new"), name)
    folder.mark(begun)
    folder.create(name)
    staged = f"{aside}/{ready}/{name}"
    for part in folder.children(staged):
        files = [f"{part}/{f}" for f in folder.children(f"{staged}/{part}")] if "=" in part else [part]
        for file in files:
            where, _, own = file.rpartition("/")
            folder.move(f"{staged}/{file}", f"{name}/{where}{'/' if where else ''}{batch}.{own}")
    folder.mark(done)
    folder.remove(aside)
    return True


def batch_rows(spark, path: str, name: str, batch: str) -> DataFrame:
    """The rows that a batch in place has added, read from its own files."""
    folder = Folder(spark, path)
    files = [*folder.matching(f"{name}/{batch}.*"), *folder.matching(f"{name}/*=*/{batch}.*")]
    if not files:
        return spark.createDataFrame([], RAW[name])
    reader = spark.read.schema(RAW[name]).option("basePath", folder.path(name))
    return reader.parquet(*[folder.path(f) for f in files]).select(*RAW[name].names)


def months_of(df: DataFrame, name: str) -> list[date | None]:
    """The months that rows of a table stored by month lie in: at most as many as the calendar has, and None for rows without a date."""
    return in_order(r[0] for r in df.select(F.trunc(STORED_BY[name], "MM").alias("m")).distinct().collect())


def in_order(months: Iterable[date | None]) -> list[date | None]:
    return sorted(set(months), key=lambda m: (m is not None, m))


def replace_months(df: DataFrame, path: str, name: str, months: list[date | None], grain: tuple[str, ...] = ()) -> None:
    """Puts new rows in place of the named months of a stored table and touches no other.

    Written aside and checked first. A month without rows any more loses its folder, which an overwrite of the partitions
    that are written would leave in place.
    """
    folder, spark = Folder(df.sparkSession, path), df.sparkSession
    aside = f"_staged/{name}"
    folder.remove(aside)
    write_table(df, folder.path("_staged"), name)
    if grain:
        require_unique(read_stored(spark, folder.path("_staged"), name, df.schema), *grain)
    fresh, by = folder.children(aside), month_folder(name)
    for month in months:
        part = f"{by}={month.isoformat() if month else '__HIVE_DEFAULT_PARTITION__'}"
        folder.remove(f"{name}/{part}")
        if part in fresh:
            folder.move(f"{aside}/{part}", f"{name}/{part}")
    folder.remove(aside)
