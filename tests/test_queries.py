from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check_queries.connect(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, connection, name):
    assert check_queries.compare(spark, connection, SF, name) == ""
