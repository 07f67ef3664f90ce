"""Session settings and the shared folder that survives a lost executor."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings the jobs are written for. All are Spark defaults or plain tuning; a cluster's
# own values win when the session already exists.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
    # a Bloom filter of the customers that a role or a region leaves drops fact rows before they shuffle; Spark builds one where the
    # fact is large (10 GB by default) and the filtered dimension below this size
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
    # compiled stages kept for the next run of a query; the default of 100 is fewer than a session uses
    "spark.sql.codegen.cache.maxEntries": "1000",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ledgerline")
    settings = {**SETTINGS, "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g", **extra}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read and write, as named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, never reused."""
    return f"{shared_folder(spark)}/ledgerline-{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a written table, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
