"""Every registered query against its SQL on the smallest sample tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, spark_rows, sql_rows
from freshet.plans.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_each_query_has_sql():
    # Queries of the subpackage that SQL cannot express are tested beside it.
    assert set(all_queries()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, connection, name):
    got = spark_rows(entry.queries()[name](spark, SF_DIR))
    assert got == sql_rows(connection, entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 5
