"""Where queries and their SQL are registered, and the common output form they are compared in."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ByteType, DateType, DecimalType, FloatType, IntegerType, ShortType

from checks.oracle_tables import with_tables
from ledgerline import Tables, with_models
from ledgerline.session import fresh_path, remove
from ledgerline.sources.projection import from_orders
from ledgerline.sources.tables import Loader

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BANKS: dict[tuple[str, str], Tables] = {}


def bank(spark: SparkSession, folder: str) -> Tables:
    """The banking tables and models over a data folder. Holds plans only, no data."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BANKS:
        others = {name: _file(folder, name) for name in ("conversations", "events")}
        _BANKS[key] = with_models(from_orders(spark, folder)).extend(others)
    return _BANKS[key]


_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A path for a table that a query writes, removed when the program ends. Local sessions without a shared folder get one."""
    if spark.conf.get("spark.checkpoint.dir", None):
        path = fresh_path(spark, label)
    elif spark.conf.get("spark.master", "").startswith("local["):
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = tempfile.mkdtemp(prefix="ledgerline-")
        path = f"{_OWN[application]}/{label}-{uuid.uuid4().hex}"
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    atexit.register(_removed, spark, path)
    return path


def _removed(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session may have ended first
        remove(spark, path)


def _file(folder: str, name: str) -> Loader:
    return lambda tables: tables.spark.read.parquet(f"{folder}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, decimals as double, dates as ISO text."""
    kinds = {
        **dict.fromkeys((ByteType, ShortType, IntegerType), "bigint"),
        **dict.fromkeys((DecimalType, FloatType), "double"),
        DateType: "string",
    }
    if not any(type(f.dataType) in kinds for f in df.schema.fields):
        return df
    return df.selectExpr(
        *[f"CAST(`{f.name}` AS {kinds[type(f.dataType)]}) AS `{f.name}`" if type(f.dataType) in kinds else f"`{f.name}`" for f in df.schema.fields]
    )


def plain_sql(sql: str, whole: str = "", real: str = "", dates: str = "") -> str:
    casts = [
        f'CAST("{c}" AS {kind}) AS "{c}"'
        for kind, names in (("BIGINT", whole), ("DOUBLE", real), ("VARCHAR", dates))
        for c in _names(names)
    ]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql


def _names(names: str) -> list[str]:
    return [n.strip() for n in names.split(",")] if names else []


def register(
    name: str,
    query: Callable[[Tables], DataFrame],
    sql: str | None = None,
    whole: str = "",
    real: str = "",
    dates: str = "",
    extra: dict[str, str] | None = None,
) -> None:
    """``query`` gets the banking tables; ``sql`` names them freely. The casts list output columns."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, folder: plain(query(bank(spark, folder)))
    if sql is not None:
        ORACLES[name] = with_tables(plain_sql(sql, whole, real, dates), extra)
