"""A session that answers queries over named views and nothing else.

Sessions of one application share the catalog of stored tables, so views of its own do not keep a session from a table that someone
saved, nor from a file that is named by its path. Here a statement has to be a query, and everything its analysed plan reads has to come out
of one of the listed views. The guard is for statements: Python code of the same process is not held back by it, and who can read
the files is the store's matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession


class UnknownTable(KeyError):
    """The table is not in this catalog, or the holder's role may not see it."""


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


# leaves of a plan that hold no stored rows
ROWLESS = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "EmptyRelation", "ResolvedInlineTable")


def _nodes(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def foreign_sources(plan, allowed: set[tuple[str | None, str]]) -> Iterator[str]:
    """What an analysed plan, its subqueries included, reads past the allowed views (database, or None if temporary, and name)."""
    open_nodes = [plan]
    while open_nodes:
        node = open_nodes.pop()
        if node.nodeName() == "View":
            found = node.desc().identifier()
            database = None if node.isTempView() or found.database().isEmpty() else found.database().get()
            if (database, found.table()) in allowed:
                continue  # what the view reads is its own matter
        below = [*_nodes(node.children()), *_nodes(node.subqueries())]
        if not below and node.nodeName() not in ROWLESS:
            yield node.simpleString(4)
        open_nodes.extend(below)


class GuardedSession:
    """``sql`` and ``table`` over the listed views: temporary ones, or those of a database, which is then the current one."""

    def __init__(self, session: SparkSession, views: Iterable[str], database: str | None = None):
        self._session, self._database = session, database
        self._allowed = {(database, name) for name in views}
        if database is not None:
            session.sql(f"USE {quoted(database)}")

    def tables(self) -> list[str]:
        return sorted(name for _, name in self._allowed)

    def sql(self, query: str) -> DataFrame:
        """The answer to a query. A statement of another kind is a syntax error here; a name that is not listed is refused."""
        self._session._jsparkSession.sessionState().sqlParser().parseQuery(query)
        df = self._session.sql(query)
        for source in foreign_sources(df._jdf.queryExecution().analyzed(), self._allowed):
            raise UnknownTable(f"the query reads past {', '.join(self.tables())}: {source}")
        return df

    def table(self, name: str) -> DataFrame:
        if (self._database, name) not in self._allowed:
            raise UnknownTable(name)
        return self.sql(f"SELECT * FROM {quoted(name)}")
