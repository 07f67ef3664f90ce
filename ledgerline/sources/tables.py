"""A named set of lazy tables.

``Tables`` answers ``ref(name)`` with a DataFrame. Whoever holds a ``Tables`` can only reach what
it names, so governed models, metrics and access roles all compose by wrapping one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ledgerline.sources.guard import GuardedSession, UnknownTable
from ledgerline.sources.schemas import RAW, stored_schema

Loader = Callable[["Tables"], DataFrame]


class Tables:
    """Named loaders, each given the catalog it is asked through. What a loader takes from another catalog it holds itself."""

    def __init__(self, spark: SparkSession, loaders: Mapping[str, Loader]):
        self.spark = spark
        self._loaders = dict(loaders)
        self._frames: dict[str, DataFrame] = {}
        self._elsewhere: dict[SparkSession, Tables] = {}

    def ref(self, name: str) -> DataFrame:
        if name not in self._loaders:
            raise UnknownTable(name)
        if name not in self._frames:
            self._frames[name] = self._loaders[name](self)
        return self._frames[name]

    def names(self) -> list[str]:
        return sorted(self._loaders)

    def extend(self, loaders: Mapping[str, Loader]) -> "Tables":
        """The same tables with some added or replaced; downstream models follow the replacement."""
        return Tables(self.spark, {**self._loaders, **loaders})

    def loader(self, name: str) -> Loader:
        """One of these tables for another catalog, which gets this table and no way to the rest."""
        return lambda tables: self.in_session(tables.spark).ref(name)

    def only(self, named: Mapping[str, str]) -> "Tables":
        """A catalog of some of these tables, new name to old. The others cannot be reached through it."""
        return Tables(self.spark, {new: self.loader(old) for new, old in named.items()})

    def in_session(self, spark: SparkSession) -> "Tables":
        """The same tables, planned by another session."""
        if spark is self.spark:
            return self
        if spark not in self._elsewhere:
            self._elsewhere[spark] = Tables(spark, self._loaders)
        return self._elsewhere[spark]

    def create_views(self, prefix: str = "") -> list[str]:
        """Expose every table to ``spark.sql`` as a temporary view of this session.

        Whoever may run SQL in a session sees every view made in it, so a restricted holder gets ``own_session``.
        """
        for name in self.names():
            self.ref(name).createOrReplaceTempView(prefix + name)
        return [prefix + name for name in self.names()]

    def own_session(self) -> "GuardedSession":
        """A new session that answers queries over these tables and refuses every other name."""
        session = self.spark.newSession()
        return GuardedSession(session, self.in_session(session).create_views())

    def imported(self, *names: str) -> "Tables":
        """Import mode: keep the named tables in memory until ``release``; the rest are read live on each query."""
        return self.extend({name: _persisted(self._loaders[name]) for name in names})

    def release(self, *names: str) -> None:
        """Gives back the memory of imported tables."""
        for name in names:
            self.ref(name).unpersist()


def _persisted(load: Loader) -> Loader:
    return lambda tables: load(tables).persist()


def read_stored(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """A stored table with its columns in their declared order."""
    full = stored_schema(name, schema)
    return spark.read.schema(full).parquet(f"{root}/{name}").select(*full.names)


def from_parquet(spark: SparkSession, root: str) -> Tables:
    """Raw tables stored one folder each, read with their declared schemas."""

    def loader(name: str) -> Loader:
        return lambda tables: read_stored(spark, root, name, RAW[name])

    return Tables(spark, {name: loader(name) for name in RAW})


def from_catalog(spark: SparkSession, schema: str, names: list[str] | None = None) -> Tables:
    """Tables of a database schema, by item name."""

    def loader(name: str) -> Loader:
        return lambda tables: tables.spark.table(f"{schema}.{name}")

    return Tables(spark, {name: loader(name) for name in names or list(RAW)})
