"""Marts kept up to date by month: only what a batch of raw rows can change is built again.

A late posting changes the month it is dated in, whenever it arrives. A reversal also takes its original out of the
month of the original, which may be long past. All other months keep their files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.models import GRAINS, MARTS, REVERSALS, with_models
from ledgerline.sources.batches import append_batch, applied, batch_rows, in_order, months_of, replace_months
from ledgerline.sources.folders import Folder
from ledgerline.sources.schemas import RAW
from ledgerline.sources.sinks import materialise, month_folder
from ledgerline.sources.tables import Tables, from_parquet, read_stored

# mart by month -> the raw table whose rows of a month make up the mart's rows of that month
FED_BY = {
    "fct_transactions": "fact_transaction",
    "fct_account_balances_monthly": "fact_daily_balance",
    "fct_loans_monthly": "fact_loan_payment",
    "fct_interest_monthly": "fact_interest_monthly",
}


def reversed_months(batch: DataFrame, ledger: DataFrame) -> list[date | None]:
    """The months of the originals that a batch reverses, wherever in the ledger they stand.

    The range of their ids reaches the files, so row groups of other ids are not read.
    """
    ids = batch.where("reversal_of_transaction_id IS NOT NULL").select(F.col("reversal_of_transaction_id").alias("transaction_id")).distinct()
    first, last = ids.agg(F.min("transaction_id"), F.max("transaction_id")).first()
    if first is None:
        return []
    originals = ledger.where(F.col("transaction_id").between(first, last)).select("transaction_id", "transaction_date")
    return months_of(originals.join(ids, "transaction_id", "left_semi"), "fact_transaction")


def changed_months(stored: Tables, batch: Mapping[str, DataFrame]) -> dict[str, list[date | None]]:
    """The months of each mart that the rows of a batch, by raw table, can change. ``stored`` holds the batch already."""
    changed = {}
    for mart, raw in FED_BY.items():
        if raw in batch:
            months = set(months_of(batch[raw], raw))
            if raw == "fact_transaction":
                months.update(reversed_months(batch[raw], stored.ref(raw)))
            changed[mart] = in_order(months)
    return changed


def in_months(raw: Tables, name: str, months: Sequence[date | None]) -> Tables:
    """The same tables with one of them cut to some of its month folders; what reverses its rows is taken from all."""
    whole, month = raw.ref(name), F.col(month_folder(name))
    kept = month.isin([m for m in months if m])
    cut = {name: lambda _: whole.where(kept | month.isNull() if None in months else kept)}
    if name == "fact_transaction":
        cut[REVERSALS] = lambda _: whole.where("reversal_of_transaction_id IS NOT NULL")
    return raw.extend(cut)


class Warehouse:
    """Raw tables under ``raw`` and marts under ``marts``, appended to by named batches.

    ``load`` writes everything; ``apply`` appends a batch and builds only the months again that it changes. A batch that is applied
    twice, or again after it was broken off, leaves the same files as one applied once. A batch with rows of a dimension changes attributes that facts of any month carry, so it builds all marts
    again. One writer at a time.
    """

    def __init__(self, spark, raw: str, marts: str):
        self.spark, self.raw_path, self.marts_path = spark, raw, marts

    def raw(self) -> Tables:
        return from_parquet(self.spark, self.raw_path)

    def load(self, batch: str, tables: Tables) -> None:
        """The first batch: all raw tables, and all marts over them."""
        for name in RAW:
            append_batch(tables.ref(name), self.raw_path, name, batch, known="refuse")
        self.rebuild()

    def rebuild(self) -> None:
        materialise(with_models(self.raw()), list(MARTS), self.marts_path, GRAINS)

    def apply(self, batch: str, rows: Mapping[str, DataFrame], known: str = "skip") -> dict[str, list[date | None]]:
        """Appends a batch of rows by raw table and brings the marts up to date. Returns the months built again, by mart.

        Raw rows are in place before marts are built, and a record is written when they are: where a run ends between, the next one
        finds the batch's own rows by their files and builds their months.
        """
        folder, done = Folder(self.spark, self.marts_path), f"_batches/{batch}"
        if folder.exists(done):
            return {}
        for name, df in rows.items():
            append_batch(df, self.raw_path, name, batch, known)
        changed: dict[str, list[date | None]] = {}
        if any(name not in FED_BY.values() for name in rows):
            self.rebuild()
        else:
            stored = self.raw()
            added = {name: batch_rows(self.spark, self.raw_path, name, batch) for name in rows}
            changed = changed_months(stored, added)
            for mart, months in changed.items():
                if months:
                    part = with_models(in_months(stored, FED_BY[mart], months))
                    replace_months(part.ref(mart), self.marts_path, mart, months, GRAINS[mart])
        folder.mark(done)
        return changed

    def batches(self, name: str) -> list[str]:
        return applied(self.spark, self.raw_path, name)

    def marts(self) -> Tables:
        """The marts as they are stored, over the raw tables for the rest."""
        models = with_models(self.raw())
        stored = {
            mart: (lambda mart: lambda t: read_stored(t.spark, self.marts_path, mart, models.ref(mart).schema))(mart) for mart in MARTS
        }
        return models.extend(stored)
