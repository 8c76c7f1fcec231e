"""Every registered record query against its SQL."""

import pytest

import lamella.buffer_queries  # noqa: F401
import lamella.format_queries  # noqa: F401
from lamella.queries import ORACLES, QUERIES
from tests.oracle import DATA, connection, same


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert df.count() > 0
        assert rows_of(df) == rows_of(QUERIES[name](spark, DATA))


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
