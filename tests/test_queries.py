"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import difference

from hearthflow.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, name):
    assert difference(name, QUERIES[name], ORACLES.get(name), spark, "0.001") is None


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
