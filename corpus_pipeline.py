"""From raw documents to tokens: language, boilerplate lines, near duplicates, source weights, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.bpe import default_vocabulary, encode_decode
from ledgerline.llm.chosenpath import without_near_duplicates
from ledgerline.llm.common import Scratch, read
from ledgerline.llm.language import fit_languages, identified
from ledgerline.llm.lines import dedup_lines
from ledgerline.llm.mixing import mix

LEAST_SHARE = 0.4  # how surely a document's words must be in learned languages


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names that no operator uses, and those names by the old ones."""
    names = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}
    return docs.select([F.col(c).alias(n) for c, n in names.items()]), names


def shown(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select([F.col(n).alias(c) for c, n in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in learned languages: null texts, texts without a letter, and texts whose words are, on average, less than
    ``LEAST_SHARE`` sure to be in the learned language that suits each best go. Clean documents of any languages that were
    learned stay, also of several at once; if none could be learned, every text with a letter stays."""
    model = fit_languages(docs)
    inside, names = hidden(docs)
    found = identified(inside, model, text_column=names["text"], sure=True)
    return shown(found.where(F.coalesce("sure", F.lit(1.0)) >= LEAST_SHARE), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more sources carry. One document keeps each such line; a document that
    loses all it had goes. ``n_chars`` follows the text."""
    inside, names = hidden(docs)
    text = names["text"]
    done = dedup_lines(inside, id_column=names["doc_id"], text_column=text, site_column=names["source"])
    done = done.where((F.col("n_removed") == 0) | (F.trim(text) != ""))
    if "n_chars" in names:
        done = done.withColumn(names["n_chars"], F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col(names["n_chars"])))
    return shown(done, names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    inside, names = hidden(docs)
    return shown(without_near_duplicates(inside, id_column=names["doc_id"], text_column=names["text"]), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks."""
    return mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the text decoded from them."""
    found = encode_decode(docs, default_vocabulary(), keep=["doc_id", "lang", "source"], whole=("ids",))
    return found.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", bpe),
]

# The field, the network of links and the merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
