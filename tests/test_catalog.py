"""Every registered query against its SQL."""

import oracle
import pytest

from millrace.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    return oracle.duck(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, data, con, name):
    assert oracle.differences(catalog.QUERIES[name](spark, data), con, catalog.ORACLE_SQL[name]) == []


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLE_SQL.keys()
