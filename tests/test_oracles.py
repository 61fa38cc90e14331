"""Every registered query of the library against its SQL, at the smallest scale."""

import pytest

from stemframe import catalogue
from tests.oracle import connect, rows_of, rows_sql

SF = "/root/testdata/sf0.001"
ORACLES = catalogue.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert rows_of(catalogue.queries()[name](spark, SF)) == rows_sql(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
