"""Mixing sources to target weights: each document is emitted a whole number of times plus one hashed draw.

Sizes are summed per source, targets are dealt by weight under a cap, and a source's rate is its target
over its size. A document is emitted ``floor(rate)`` times and once more when a number in [0, 1) hashed
from its id falls below the fraction of the rate, so any rerun takes the same copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, hidden, read

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the id (the text where there is none): 52 bits of a digest."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(
    sizes: DataFrame, weights: Sequence[int], share: float, cap: float, scratch: Scratch
) -> DataFrame:
    """``_source, _source_size, _target`` of each source from ``_source, _source_size``.

    Sources take the weights in turn in the order of their code points, NULL last. The order of all
    sources comes from a range partitioning: a source's place is its place in its partition plus the rows
    of the partitions before, and only those partition counts meet in one task.
    """
    by_name = F.col("_source").asc_nulls_last()
    ordered = scratch.save(
        sizes.repartitionByRange(by_name).sortWithinPartitions(by_name)
        .withColumn("_at", F.monotonically_increasing_id()),
        "sources",
    )
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = ordered.groupBy(part.alias("_part")).count().select(
        "_part",
        F.coalesce(
            F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    turn = F.pmod(F.col("_before") + place, F.lit(len(weights))).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    ranked = scratch.save(
        ordered.withColumn("_part", part).join(before, "_part")
        .select("_source", "_source_size", weight.alias("_weight")),
        "weights",
    )
    whole, level, capped = None, 0.0, -1
    most = F.col("_source_size") * F.lit(float(cap))
    while True:  # one row comes back each time; a source that is capped once stays capped
        over = most < F.col("_weight") * F.lit(level)
        row = ranked.agg(
            F.sum("_source_size").alias("whole"),
            F.sum(F.when(over, most).otherwise(0.0)).alias("taken"),
            F.sum(F.when(over, 0.0).otherwise(F.col("_weight"))).alias("weight"),
            F.count(F.when(over, 1)).alias("capped"),
        ).first()
        whole = row["whole"]
        if not whole or row["capped"] == capped:
            break
        capped = row["capped"]
        if not row["weight"]:  # every source is at its cap
            level = float("inf")
            break
        level = (share * whole - row["taken"]) / row["weight"]
    target = F.least(most, F.col("_weight") * F.lit(level))
    return ranked.select("_source", "_source_size", target.alias("_target"))


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies`` of each document.

    - Size is the number of runs of anything but ASCII white space; a null or empty text has size 0.
    - Sources share ``share`` of all sizes by weight; a target stops at ``cap`` times its source's size and
      the excess is shared again by weight until none is above.
    - A source of size 0 has target 0 and rate 0. A null source is a source of its own, last in order.
    - Rows with one id share one draw, so a repeated row is repeated alike; rows without an id draw by text.
    - An empty table gives no rows. Columns of ``docs`` named like a computed one are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    inside, names = hidden(docs.drop("size", "source_size", "target", "rate", "copies"))
    name, text, source = (F.col(names[c]) for c in (id_column, text_column, source_column))
    sized = inside.withColumn("_size", words(text))
    totals = sized.groupBy(source.alias("_source")).agg(F.sum("_size").alias("_source_size"))
    # a row per source; its size is bounded by the sources, and adaptive execution decides how it is joined
    targets = source_targets(totals, weights, share, cap, scratch)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    extra = (draw(name, text, seed) < F.col("_rate") - F.floor("_rate")).cast("long")
    return (
        sized.join(targets, source.eqNullSafe(F.col("_source")), "left")
        .withColumn("_rate", rate)
        .select(
            *[F.col(n).alias(c) for c, n in names.items()],
            F.col("_size").alias("size"),
            F.col("_source_size").alias("source_size"),
            F.col("_target").alias("target"),
            F.col("_rate").alias("rate"),
            (F.floor("_rate").cast("long") + extra).alias("copies"),
        )
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """Every document as often as its source's rate asks, with the columns of ``docs``, whatever their names; see ``mixed``."""
    plan = mixed(docs.select([F.col(c).alias(f"_in{i}") for i, c in enumerate(docs.columns)]), **{
        **options,
        **{
            f"{name}_column": f"_in{docs.columns.index(options.get(f'{name}_column', default))}"
            for name, default in (("id", "doc_id"), ("text", "text"), ("source", "source"))
        },
    })
    taken = plan.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select([F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_mix_sources(spark, folder) -> DataFrame:
    plan = mixed(read(spark, folder, "documents"))
    taken = F.col("size") * F.col("copies")
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM totals
), levels AS (
  SELECT 2.0::DOUBLE * source_size / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER earlier, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM weighed
  WINDOW earlier AS (ORDER BY 2.0::DOUBLE * source_size / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT level FROM levels WHERE ratio >= level ORDER BY ratio LIMIT 1
), targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * level) AS target FROM weighed, chosen
)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(rate) + CASE WHEN CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13)) AS BIGINT)
    / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
"""
