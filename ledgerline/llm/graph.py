"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``v, label`` of every vertex that has a link ``a, b`` (longs): the smallest vertex it can reach.

    Each round hangs the larger neighbours of a vertex, then the smaller ones, on the least of them; the rounds grow
    with the logarithm of a component's width. Every step is an aggregation with map-side combine and a join to
    one row per vertex, so a vertex with millions of links is no group that a task must hold. A vertex that is itself the
    smallest of its component has no row. The aggregates are saved before they are joined, since adaptive execution splits a
    hot key only between exchanges.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = scratch.save(ordered, "stars"), None
    state = _state(now)
    while state != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = scratch.save(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        lowest = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u")
        hung = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = scratch.save(hung.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        for done in (now, least, large, lowest):
            scratch.drop(done)
        now, before, state = following, state, _state(following)
    return now.select(F.col("u").alias("v"), F.col("v").alias("label"))


def _state(stars: DataFrame) -> tuple:
    row = stars.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
