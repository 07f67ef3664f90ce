"""Access roles enforced on the tables: row filters, hidden columns and hidden tables.

A role gets its own catalog. Metrics and models built from it read restricted inputs only, and its SQL runs in a session of
its own (``Tables.own_session``) that refuses every name but the role's. ``save_role_views`` stores the same as views in a database
of the role, over marts saved for all: every session of the application can use them, and rows are filtered for
whoever reads. Who can name the files themselves is the store's matter, not this module's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.joins import lookup
from ledgerline.sources.guard import GuardedSession, quoted
from ledgerline.sources.tables import Loader, Tables

CUSTOMERS = "dim_customers"
CUSTOMER_FACTS = ("fct_transactions", "fct_account_balances_monthly", "fct_loans_monthly", "fct_interest_monthly")
CREDIT_TABLES = ("fct_loans_monthly", "fct_interest_monthly")


@dataclass(frozen=True)
class Role:
    name: str
    customer_filter: str | None = None  # SQL condition on the customers
    hidden_columns: Mapping[str, Sequence[str]] = field(default_factory=dict)
    hidden_tables: Sequence[str] = ()


def literal(text: str) -> str:
    """A text as SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The default branch and region of the roles, and what each role may not see.
def standard_roles(branch: str = "Mississauga West", region: str = "Eastern-ON") -> dict[str, Role]:
    """The four roles: neither mechanism, rows only, columns and tables only, both."""
    no_names = {CUSTOMERS: ("customer_name",)}
    return {
        role.name: role
        for role in (
            Role("National Analyst"),
            Role("Branch Manager", f"home_branch_name = {literal(branch)}"),
            Role("Retail Analyst", None, no_names, CREDIT_TABLES),
            Role("Restricted User", f"region = {literal(region)}", no_names, CREDIT_TABLES),
        )
    }


def _restricted(fact: Loader, customers: Loader) -> Loader:
    return lambda tables: lookup(fact(tables), customers(tables).select("customer_id"), "customer_id", "left_semi")


def _facts_of(marts: Tables, customers: Loader, hidden: Sequence[str] = ()) -> dict[str, Loader]:
    return {n: _restricted(marts.loader(n), customers) for n in CUSTOMER_FACTS if n in marts.names() and n not in hidden}


def for_role(marts: Tables, role: Role) -> Tables:
    """The catalog a role may read. Hidden tables are absent, hidden columns are gone from the schema."""
    mine = marts.only({name: name for name in marts.names() if name not in role.hidden_tables})
    if role.customer_filter is not None:
        everyone = marts.loader(CUSTOMERS)

        def customers(tables: Tables) -> DataFrame:
            return everyone(tables).where(role.customer_filter)

        mine = mine.extend({CUSTOMERS: customers, **_facts_of(marts, customers, role.hidden_tables)})
    for table, columns in role.hidden_columns.items():
        mine = mine.extend({table: _dropping(mine._loaders[table], columns)})
    return mine


def for_identity(marts: Tables, entitlements: DataFrame, identity: str) -> Tables:
    """Rows of the branches a person is entitled to, from a bridge table (identity, home_branch_name)."""
    mine, everyone = entitlements.where(F.col("identity") == identity).select("home_branch_name").distinct(), marts.loader(CUSTOMERS)

    def customers(tables: Tables) -> DataFrame:
        return everyone(tables).join(mine, "home_branch_name", "left_semi")

    allowed = marts.only({name: name for name in marts.names()})
    return allowed.extend({CUSTOMERS: customers, **_facts_of(marts, customers)})


def entitled_by(bridge: str) -> str:
    """A customer filter by a stored bridge table (identity, home_branch_name): the branches of whoever reads, at the time they read."""
    return f"home_branch_name IN (SELECT home_branch_name FROM {bridge} WHERE identity = session_user())"


def save_role_views(spark: SparkSession, saved: str, database: str, role: Role, names: Sequence[str]) -> list[str]:
    """Stores what a role may read as views in ``database``, over the marts saved in the database ``saved``. Returns their names.

    A view keeps its text, not its rows: filters, ``session_user()`` and bridge tables in them are evaluated when it is read, so a
    changed entitlement holds from the next query on. Views of a former definition that the role may no longer read are dropped.
    """
    visible = [n for n in names if n not in role.hidden_tables]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}")
    for old in spark.catalog.listTables(quoted(database)):
        if old.tableType == "VIEW" and old.name not in visible:
            spark.sql(f"DROP VIEW {quoted(database)}.{quoted(old.name)}")
    for name in sorted(visible, key=lambda n: n != CUSTOMERS):  # facts look at the role's customers
        source = f"{quoted(saved)}.{quoted(name)}"
        hidden = role.hidden_columns.get(name, ())
        columns = ", ".join(quoted(c) for c in spark.table(source).columns if c not in hidden)
        condition = ""
        if role.customer_filter is not None and name == CUSTOMERS:
            condition = f" WHERE {role.customer_filter}"
        elif role.customer_filter is not None and name in CUSTOMER_FACTS:
            condition = f" WHERE customer_id IN (SELECT customer_id FROM {quoted(database)}.{quoted(CUSTOMERS)})"
        spark.sql(f"CREATE OR REPLACE VIEW {quoted(database)}.{quoted(name)} AS SELECT {columns} FROM {source}{condition}")
    return sorted(visible)


def role_session(spark: SparkSession, database: str) -> GuardedSession:
    """A session in which the views of a role's database are the only names there are."""
    views = [t.name for t in spark.catalog.listTables(quoted(database)) if t.tableType == "VIEW"]
    return GuardedSession(spark.newSession(), views, database)


def _dropping(load: Loader, columns: Sequence[str]) -> Loader:
    return lambda tables: load(tables).drop(*columns)


REPORT_NAMES = {
    "dim_customers": {"customer_name": "Customer Name", "region": "Region"},
    "fct_transactions": {"transaction_type": "Transaction Type"},
}


def with_report_names(marts: Tables) -> Tables:
    """Columns renamed the way reports show them; names a role hides stay hidden."""

    def renamed(name: str) -> Loader:
        load = marts.loader(name)
        return lambda tables: load(tables).withColumnsRenamed(REPORT_NAMES[name])

    same = marts.only({name: name for name in marts.names()})
    return same.extend({name: renamed(name) for name in REPORT_NAMES if name in marts.names()})
