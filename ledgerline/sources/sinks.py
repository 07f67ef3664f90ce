"""Writing tables: typed creation, appends, partitioned marts, and the result log."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from ledgerline.functions.answer_text import single_line
from ledgerline.functions.calendar import month_start, partition_of
from ledgerline.operators.joins import require_unique
from ledgerline.sources.folders import Folder
from ledgerline.sources.schemas import CLUSTERED_BY, RAW, STORED_BY
from ledgerline.sources.tables import Loader, Tables, from_parquet, read_stored

RESULT_LOG = StructType(
    [
        StructField(name, kind, True)
        for name, kind in (
            ("config", StringType()),
            ("question_set", StringType()),
            ("run", IntegerType()),
            ("question_id", StringType()),
            ("answerable_expected", BooleanType()),
            ("ambiguity_tag", StringType()),
            ("generated_sql", StringType()),
            ("refused", BooleanType()),
            ("execution_error", StringType()),
            ("model_result", DoubleType()),
            ("expected_result", DoubleType()),
            ("failure_category", StringType()),
        )
    ]
)


QUESTIONS = StructType(
    [
        StructField(name, kind, True)
        for name, kind in (
            ("id", StringType()),
            ("question", StringType()),
            ("answerable", BooleanType()),
            ("ambiguity_tag", StringType()),
            ("sql", StringType()),
            ("expected_result", DoubleType()),
            ("business_definition", StringType()),
        )
    ]
)


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """The declared columns in the declared order and types; a missing column fails here."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def month_folder(name: str) -> str:
    """The column whose months are the folders of a stored table."""
    day = STORED_BY[name]
    return day if day == "month_start" else partition_of(day)


def write_table(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    """One folder per table, split by month where the table has a date.

    ``rebalance`` lets adaptive execution cut a month that holds most of the rows into several
    files and merge months that hold few, instead of one task per month. The marts' rows lie by customer in each file.
    """
    writer = df.write
    if name in STORED_BY:
        day, folder = STORED_BY[name], month_folder(name)
        if folder != day:
            df = df.withColumn(folder, month_start(F.col(day)))
        df = df.hint("rebalance", folder)
        if name in CLUSTERED_BY:
            df = df.sortWithinPartitions(folder, CLUSTERED_BY[name])
        writer = df.write.partitionBy(folder)
    writer.mode(mode).parquet(f"{path}/{name}")


def create_raw(tables: Tables, path: str, names: Iterable[str] = tuple(RAW)) -> Tables:
    """Drop and create the raw tables with their types; running it twice gives the same tables."""
    for name in names:
        write_table(typed(tables.ref(name), RAW[name]), path, name)
    return from_parquet(tables.spark, path)


def append_rows(df: DataFrame, path: str, name: str) -> None:
    write_table(typed(df, RAW[name]), path, name, mode="append")


def materialise(tables: Tables, names: Iterable[str], path: str, grains: Mapping[str, Sequence[str]] = {}) -> Tables:
    """Write the named models once and let everything downstream read the files.

    ``grains`` names the columns that tell a table's rows apart. A table that repeats them is refused: joins
    to it and metrics over it would count rows twice. It is written aside and checked before it takes the place of
    the one that stands there, so a refused table changes nothing.
    """
    folder = Folder(tables.spark, path)
    for name in names:
        df = tables.ref(name)
        folder.remove(f"_staged/{name}")
        write_table(df, folder.path("_staged"), name)
        if name in grains:
            require_unique(read_stored(tables.spark, folder.path("_staged"), name, df.schema), *grains[name])
        folder.remove(name)
        folder.move(f"_staged/{name}", name)
        tables = tables.extend({name: _stored(path, name, df.schema)})
    return tables


def _stored(path: str, name: str, schema: StructType) -> Loader:
    return lambda tables: read_stored(tables.spark, path, name, schema)


def save_as_tables(
    tables: Tables, names: Iterable[str], database: str, buckets: Mapping[str, tuple[str, int]] | None = None
) -> None:
    """Register tables in the session catalog, where ``from_catalog`` finds them by name.

    ``buckets`` stores a table hashed by a key, e.g. the ledger by transaction id: the join that nets
    reversals, the widest shuffle there is, then leaves the ledger where it lies.
    """
    for name in names:
        writer = tables.ref(name).write.mode("overwrite")
        if buckets and name in buckets:
            key, pieces = buckets[name]
            writer = tables.ref(name).repartition(pieces, key).write.mode("overwrite").bucketBy(pieces, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")


def write_questions(questions: DataFrame, path: str) -> None:
    """Question records, one JSON object a line."""
    typed(questions, QUESTIONS).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).json(path)


def write_result_log(df: DataFrame, path: str) -> None:
    """The log as CSV, an answer a line: line ends in a text become spaces, so the files can be split when read."""
    texts = [f.name for f in RESULT_LOG.fields if isinstance(f.dataType, StringType)]
    flat = typed(df, RESULT_LOG).withColumns({c: single_line(F.col(c)) for c in texts})
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_result_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_LOG).option("header", True).option("escape", '"').csv(path)
