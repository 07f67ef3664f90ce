"""Line dedup by distinct-site spread: lines that many sites carry are boilerplate.

Each line hash gets a HyperLogLog sketch of its sites, merged by the aggregation. Lines whose estimate is
far above the threshold are boilerplate, far below are not, and those near it are counted exactly. All of it
is built-in Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, hidden, read, text_key


def spread_lines(lines: DataFrame, min_sites: int, precision: int, scratch: Scratch) -> DataFrame:
    """``_hash, _keeper`` of the lines that at least ``min_sites`` sites carry.

    ``lines`` has ``_hash, _site, _holder``; the keeper is the smallest holder. The sketch of ``precision``
    bits is off by 1.04 / sqrt(2^precision) on average; the band that is counted exactly is five times
    that wide on each side, and one site more. A site that is null counts for nothing. Aggregates are saved before they meet
    the lines again, since adaptive execution splits a hot line only between exchanges.
    """
    band = 5 * 1.04 / (1 << precision) ** 0.5
    low, high = min_sites * (1 - band) - 1, min_sites * (1 + band) + 1
    merged = lines.groupBy("_hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("_site", precision)).alias("_sites"),
        F.min("_holder").alias("_keeper"),
    )
    spread = scratch.save(merged.where(F.col("_sites") >= F.lit(low)), "spread")
    sure = spread.where(F.col("_sites") > F.lit(high)).select("_hash", "_keeper")
    near = spread.where(F.col("_sites") <= F.lit(high)).select("_hash", "_keeper")
    exact = (
        lines.where(F.col("_site").isNotNull()).select("_hash", "_site")
        .join(near.select("_hash"), "_hash", "left_semi")
        .distinct().groupBy("_hash").count().where(F.col("count") >= min_sites)
    )
    return scratch.save(sure.unionByName(near.join(exact.select("_hash"), "_hash")), "boilerplate")


def dedup_lines(
    docs: DataFrame,
    min_sites: int = 10,
    precision: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    site_column: str = "source",
) -> DataFrame:
    """``docs`` without boilerplate lines, plus ``n_lines`` and ``n_removed``.

    - Lines are the parts between ``\\n``, compared as they are; lines of blanks only are never boilerplate.
    - A line carried by ``min_sites`` or more distinct sites goes from every document but one: the one with
      the smallest id (smallest digest among rows of one id, null ids last) keeps it, so no line is lost.
    - A null text stays null with 0 lines; an empty text has one line, which is blank.
    - A text that loses all its lines becomes empty. Rows repeated in full are treated alike.
    - Columns named ``n_lines`` or ``n_removed`` are replaced. An empty table gives no rows.

    A line that fills a third of the table reaches the shuffle as one sketch per task. Joining the lines
    back to the boilerplate is a join on a key unique on one side, which adaptive execution splits.
    """
    inside, names = hidden(docs.drop("n_lines", "n_removed"))
    text, site = F.col(names[text_column]), F.col(names[site_column])
    name = F.coalesce(F.col(names[id_column]).cast("long"), F.lit((1 << 63) - 1))
    lines = (
        inside.where(text.isNotNull())
        .select(
            F.struct(name.alias("id"), text_key(text).alias("key")).alias("_holder"),
            site.cast("string").alias("_site"),
            F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"),
        )
        .where(F.trim("_line") != "")
        .select("_holder", "_site", "_pos", F.unhex(F.md5(F.col("_line").cast("binary"))).alias("_hash"))
    )
    gone = (
        lines.join(spread_lines(lines, min_sites, precision, Scratch(docs.sparkSession)), "_hash")
        .where(F.col("_holder") != F.col("_keeper"))
        .groupBy("_holder").agg(F.collect_set("_pos").alias("_gone"))
        .select(F.col("_holder.id").alias("_gid"), F.col("_holder.key").alias("_gkey"), "_gone")
    )
    same = (name == F.col("_gid")) & (F.col("_key") == F.col("_gkey"))
    parts = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("_gone", i)), "\n")
    return inside.withColumn("_key", text_key(text)).join(gone, same, "left").select(
        *[
            (F.when(F.col("_gone").isNull(), text).otherwise(kept) if c == text_column else F.col(n)).alias(c)
            for c, n in names.items()
        ],
        F.coalesce(F.size(F.when(text.isNotNull(), parts)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("long").alias("n_removed"),
    )


def op8_line_dedup(spark, folder) -> DataFrame:
    """Every document with its number of lines, of removed lines, and a digest of what is left."""
    done = dedup_lines(read(spark, folder, "documents"))
    left = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return done.select("doc_id", "n_lines", "n_removed", left.alias("kept_sha256"))


SQL = r"""
WITH parts AS (
  SELECT doc_id, source, coalesce(md5(text), '') AS digest,
    unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), spread AS (
  SELECT line, min(struct_pack(id := coalesce(doc_id, 9223372036854775807), digest := digest)) AS keeper
  FROM parts WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT p.doc_id, p.digest, p.pos, p.line,
    s.line IS NOT NULL AND struct_pack(id := coalesce(p.doc_id, 9223372036854775807), digest := p.digest) <> s.keeper AS gone
  FROM (SELECT DISTINCT doc_id, digest, pos, line FROM parts) p LEFT JOIN spread s ON p.line = s.line
), kept AS (
  SELECT doc_id, digest, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id, digest
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND md5(d.text) = k.digest
"""
