"""A bounded, repeatable sample of labelled documents to fit a model on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import best


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def drawn(n: int, most: int, rng: np.random.Generator) -> np.ndarray:
    """``most`` of the places 0 to ``n``, one from each of as many equal stretches, or all places if they are no more."""
    if n <= most:
        return np.arange(n)
    edges = np.arange(most + 1) * n // most
    return rng.integers(edges[:-1], edges[1:])


def labelled_sample(docs: DataFrame, labelled: DataFrame, label: str, per_label: int, most: int) -> Iterator[tuple[str, object]]:
    """``(text, label)`` of at most ``per_label`` documents of each label; ``most`` documents are shared among
    labels that are too many for that, and each label has one at least.

    ``labelled`` has ``doc_id`` and the label, ``docs`` has ``doc_id, text``. The documents are those of least hash of their id: from
    the count of a label follows a hash that about twice as many stay below, only ids below it are ranked, and the chosen ids go to where the texts are. Of
    rows with one id the least label and text are taken. At most ``most`` texts come back, or one a label, in the order of their ids, a partition at a time.
    """
    one = labelled.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    counts = one.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.count()
    if not labels:
        return
    per_label = min(per_label, max(1, most // labels))
    few = F.broadcast(counts) if labels <= 1000 else counts  # else ids would move by label before they are dropped
    hashed = one.withColumn("_order", F.xxhash64("doc_id")).join(few, "label")
    below = (F.col("_order") / 2.0**64 + 0.5) * F.col("n") <= 2 * per_label + 200  # fewer than per_label of a label: less than once in 10^15
    chosen = best(hashed.where(below), "label", [F.col("_order"), F.col("doc_id")], per_label)
    # a proven bound: most ids, or one for each label
    found = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).orderBy("doc_id")
    for r in rows.toLocalIterator():
        yield r["text"], r["label"]
