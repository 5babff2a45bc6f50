"""Every registered query of the graph engine against its SQL."""

import oracle
import pytest

from loomgraph import catalogue


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, con, name):
    oracle.assert_same(catalogue.queries()[name](spark, oracle.DATA), catalogue.oracle_sql()[name], con)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
