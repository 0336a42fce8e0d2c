"""Every registered query that SQL can express, on the smallest tables."""

import pytest

from isohyet.plans import registry
from tests.oracle import connect, rows_of_duckdb, rows_of_spark

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    assert rows_of_spark(registry.queries()[name](spark, SF_DIR)) == rows_of_duckdb(con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_other_queries_run_alike(spark, name):
    query = registry.queries()[name]
    assert rows_of_spark(query(spark, SF_DIR)) == rows_of_spark(query(spark, SF_DIR))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
