"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.registry import ORACLE, QUERIES
from checks.compare import compare, duck_connection


@pytest.fixture(scope="module")
def con(data):
    connection = duck_connection(data)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    ok, note = compare(spark, con, data, name)
    assert ok, note


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
