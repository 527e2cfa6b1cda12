import pytest

from loglathe import queries
from oracle import assert_equal, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    assert_equal(queries.QUERIES[name](spark, sf), con, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
