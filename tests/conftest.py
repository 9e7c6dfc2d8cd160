from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hearthflow.session import local_session  # noqa: E402
from hearthflow.sources.fixture import readings as read  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("hearthflow-tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def readings(spark):
    return read(spark, SMALL).cache()


@pytest.fixture
def rows(spark):
    """Rows of a small table given as (schema, list of tuples)."""

    def build(schema, values):
        return spark.createDataFrame(values, schema)

    return build
