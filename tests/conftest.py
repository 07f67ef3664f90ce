import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from checks.compare import connect  # noqa: E402
from checks.registry import bank  # noqa: E402
from ledgerline.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("spark")
    session = local_session(
        8,
        **{
            "spark.sql.warehouse.dir": str(scratch / "warehouse"),
            "spark.checkpoint.dir": str(scratch / "shared"),
            "spark.sql.catalogImplementation": "in-memory",
            "spark.sql.maxMetadataStringLength": "5000",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return bank(spark, FOLDER)


@pytest.fixture(scope="session")
def duck():
    return connect(FOLDER)


@pytest.fixture
def no_broadcast(spark):
    """Take the route large dimensions take: shuffles, with hot keys salted."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
