"""Helpers shared by the operators: reading tables, cutting lineage, keys of texts, top-k."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is set a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="llm-")
    return _LOCAL[application]


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.root}/{label}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.scratch_path = path
        return saved

    def drop(self, saved: DataFrame) -> None:
        """Removes a table that nothing will read again."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(saved.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def batches_of(texts: Iterable[str | None], most: int = 1 << 19) -> Iterator[list[str | None]]:
    """Runs of texts of about ``most`` characters, so that what is held at once grows neither with a batch nor with long texts in it."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names that no operator uses, and those names by the old ones."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; NULL counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def best(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their rank; tasks drop what cannot be among them before the shuffle."""
    window = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
