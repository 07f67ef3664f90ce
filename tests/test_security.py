import pytest
from pyspark.errors import AnalysisException, ParseException

from ledgerline.operators import security
from ledgerline.plans import metrics as m
from ledgerline.plans.models import marts
from ledgerline.plans.report_measures import evaluate
from checks.compare import rows_of
from ledgerline.sources.sinks import save_as_tables
from ledgerline.sources.tables import Tables, UnknownTable

ROLES = security.standard_roles("NATION_7", "ASIA")


def content(df):
    return rows_of(df.columns, df.collect())


@pytest.fixture(scope="module")
def role(tables):
    return lambda name: security.for_role(marts(tables), ROLES[name])


def test_the_two_mechanisms_are_independent():
    shape = {n: (r.customer_filter is not None, bool(r.hidden_columns), bool(r.hidden_tables)) for n, r in ROLES.items()}
    assert shape == {
        "National Analyst": (False, False, False),
        "Branch Manager": (True, False, False),
        "Retail Analyst": (False, True, True),
        "Restricted User": (True, True, True),
    }


def test_unrestricted_role_sees_everything(tables, role):
    assert role("National Analyst").names() == marts(tables).names()
    assert role("National Analyst").ref("dim_customers").count() == tables.ref("dim_customers").count()


@pytest.mark.parametrize("name", ["Retail Analyst", "Restricted User"])
def test_hidden_objects_raise(role, name):
    mine = role(name)
    for table in security.CREDIT_TABLES:
        with pytest.raises(UnknownTable):
            mine.ref(table)
    with pytest.raises(UnknownTable):
        m.query(mine, ["delinquency_rate_30d"])
    with pytest.raises(AnalysisException):
        mine.ref("dim_customers").select("customer_name").collect()


def test_raw_tables_are_out_of_reach(role):
    for table in ("fact_transaction", "dim_customer", "stg_transactions"):
        with pytest.raises(UnknownTable):
            role("Restricted User").ref(table)


@pytest.mark.parametrize("name, column, value", [("Branch Manager", "home_branch_name", "NATION_7"), ("Restricted User", "region", "ASIA")])
def test_rows_are_restricted_in_every_fact(tables, role, name, column, value):
    mine, everyone = role(name), tables.ref("dim_customers")
    ids = {r[0] for r in everyone.where(everyone[column] == value).select("customer_id").collect()}
    assert mine.ref("fct_transactions").count() > 0
    for fact in security.CUSTOMER_FACTS:
        if fact in mine.names():
            seen = {r[0] for r in mine.ref(fact).select("customer_id").distinct().collect()}
            assert seen <= ids


def test_facts_are_restricted_on_the_shuffle_route_too(tables, role, no_broadcast):
    fast = role("Branch Manager").ref("fct_transactions").count()
    ids = tables.ref("dim_customers").where("home_branch_name = 'NATION_7'").select("customer_id")
    assert fast == tables.ref("fct_transactions").join(ids, "customer_id", "left_semi").count()


def test_measures_cannot_replace_a_role_filter(role):
    mine = role("Restricted User")
    regions = {r[0] for r in evaluate(mine, ["Active Customer Count"], by=["region"]).collect()}
    assert regions == {"ASIA"}


def test_a_roles_session_reaches_nothing_of_others(spark, tables, role):
    """Views of an unrestricted holder stand in the first session; the role's has its own tables only."""
    marts(tables).create_views()
    tables.create_views("raw_")
    assert spark.sql("SELECT count(*) FROM fct_loans_monthly").first()[0] > 0
    session = role("Restricted User").own_session()
    assert session.tables() == role("Restricted User").names()
    assert session.sql("SELECT count(*) FROM dim_customers").first()[0] > 0
    assert session.sql("SELECT count(*) FROM dim_customers WHERE region <> 'ASIA'").first()[0] == 0
    strangers = "SELECT count(*) FROM fct_transactions WHERE customer_id NOT IN (SELECT customer_id FROM dim_customers)"
    assert session.sql(strangers).first()[0] == 0
    for hidden in ("SELECT * FROM fct_loans_monthly", "SELECT * FROM raw_fact_transaction", "SELECT customer_name FROM dim_customers", "SELECT * FROM global_temp.fct_loans_monthly"):
        with pytest.raises(AnalysisException):
            session.sql(hidden)
    for view in [t.name for t in spark.catalog.listTables() if t.isTemporary]:
        spark.catalog.dropTempView(view)


@pytest.fixture(scope="module")
def saved(spark, tables):
    spark.sql("CREATE DATABASE IF NOT EXISTS bank")
    save_as_tables(marts(tables), marts(tables).names(), "bank")
    return "bank"


OUTSIDE = [
    "SELECT count(*) FROM {saved}.fct_loans_monthly",
    "SELECT count(*) FROM spark_catalog.{saved}.fct_loans_monthly",
    "SELECT 1 WHERE EXISTS (SELECT 1 FROM {saved}.fct_loans_monthly)",
    "WITH l AS (SELECT * FROM {saved}.fct_loans_monthly) SELECT count(*) FROM l",
    "SELECT (SELECT max(customer_name) FROM {saved}.dim_customers)",
    "SELECT c.region FROM dim_customers c, LATERAL (SELECT * FROM {saved}.dim_customers d WHERE d.customer_id = c.customer_id)",
    "SELECT * FROM fct_transactions UNION ALL SELECT * FROM {saved}.fct_transactions",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/customer.parquet`",
    "SELECT * FROM strangers_view",
]
COMMANDS = ["CREATE TABLE stolen AS SELECT * FROM {saved}.fct_loans_monthly", "CREATE TEMPORARY VIEW v AS SELECT 1", "DROP TABLE {saved}.dim_customers", "SHOW TABLES IN {saved}", "SET a = b"]


@pytest.mark.parametrize("stored", [False, True])
def test_statements_cannot_leave_a_role(spark, role, saved, stored):
    spark.sql(f"CREATE OR REPLACE VIEW strangers_view AS SELECT * FROM {saved}.fct_loans_monthly")
    if stored:
        security.save_role_views(spark, saved, "restricted", ROLES["Restricted User"], role("National Analyst").names())
        session = security.role_session(spark, "restricted")
    else:
        session = role("Restricted User").own_session()
    for statement in OUTSIDE:
        with pytest.raises((UnknownTable, AnalysisException)):
            session.sql(statement.format(saved=saved))
    for statement in COMMANDS:
        with pytest.raises(ParseException):
            session.sql(statement.format(saved=saved))
    for name in security.CREDIT_TABLES:
        with pytest.raises(UnknownTable):
            session.table(name)
    inside = """WITH big AS (SELECT customer_id, sum(amount) AS s FROM fct_transactions GROUP BY 1)
                SELECT count(*), (SELECT count(*) FROM dim_dates) FROM big WHERE customer_id IN (SELECT customer_id FROM dim_customers)
                AND EXISTS (SELECT 1 FROM VALUES (1), (2)) AND 3 > (SELECT max(id) FROM range(3))"""
    people, days = session.sql(inside).first()
    assert 0 < people <= session.table("dim_customers").count() and days == role("National Analyst").ref("dim_dates").count()
    spark.sql("DROP VIEW strangers_view")


def test_the_catalog_of_a_role_holds_no_way_to_the_rest(role):
    mine = role("Restricted User")
    assert not hasattr(mine, "base") and not any(isinstance(v, Tables) for v in vars(mine).values())


@pytest.mark.parametrize("name", sorted(ROLES))
def test_stored_views_are_the_roles_tables(spark, role, saved, name):
    mine, database = role(name), "role_" + name.lower().replace(" ", "_")
    assert security.save_role_views(spark, saved, database, ROLES[name], role("National Analyst").names()) == mine.names()
    session = security.role_session(spark, database)
    for table in mine.names():
        view = session.table(table)
        assert sorted(view.columns) == sorted(mine.ref(table).columns) and content(view) == content(mine.ref(table))


def test_stored_views_follow_the_reader_and_the_bridge(spark, tables, saved):
    me = spark.sql("SELECT session_user()").first()[0]

    def entitle(*rows):
        spark.createDataFrame(rows, "identity string, home_branch_name string").write.mode("overwrite").saveAsTable(f"{saved}.entitlements")

    entitle((me, "NATION_1"), (me, "NATION_1"), ("someone else", "NATION_2"))
    by_person = security.Role("By person", security.entitled_by(f"{saved}.entitlements"), {}, ("fct_interest_monthly",))
    names = security.save_role_views(spark, saved, "by_person", by_person, marts(tables).names())
    branches = lambda: {r[0] for r in security.role_session(spark, "by_person").sql("SELECT DISTINCT home_branch_name FROM dim_customers").collect()}
    facts = lambda: security.role_session(spark, "by_person").table("fct_transactions").count()
    assert branches() == {"NATION_1"} and "fct_interest_monthly" not in names
    ids = tables.ref("dim_customers").where("home_branch_name = 'NATION_1'").select("customer_id")
    assert facts() == tables.ref("fct_transactions").join(ids, "customer_id", "left_semi").count() > 0
    entitle((me, "NATION_2"), (me, "NATION_3"))
    assert branches() == {"NATION_2", "NATION_3"}
    entitle(("someone else", "NATION_2"))
    assert branches() == set() and facts() == 0
    # a narrower definition takes views away
    assert "fct_loans_monthly" in security.role_session(spark, "by_person").tables()
    security.save_role_views(spark, saved, "by_person", security.Role("By person", "false", {}, security.CREDIT_TABLES), marts(tables).names())
    assert "fct_loans_monthly" not in security.role_session(spark, "by_person").tables()


def test_names_and_texts_are_quoted(spark, tables, saved):
    odd = security.Role("Odd", f"home_branch_name = {security.literal(chr(39) + ' OR true --' + chr(92))}")
    assert security.for_role(marts(tables), odd).ref("dim_customers").count() == 0
    security.save_role_views(spark, saved, "order", odd, ["dim_customers"])
    assert security.role_session(spark, "order").table("dim_customers").count() == 0


def test_identity_bridge(spark, tables):
    bridge = spark.createDataFrame([("ann", "NATION_1"), ("ann", "NATION_1"), ("bob", "NATION_2")], "identity string, home_branch_name string")
    mine = security.for_identity(marts(tables), bridge, "ann")
    assert {r[0] for r in mine.ref("dim_customers").select("home_branch_name").distinct().collect()} == {"NATION_1"}
    assert security.for_identity(marts(tables), bridge, "eve").ref("fct_transactions").count() == 0


def test_report_names(role):
    named = security.with_report_names(role("Restricted User"))
    assert "Region" in named.ref("dim_customers").columns and "Customer Name" not in named.ref("dim_customers").columns
