"""Every query gives the rows of its SQL in DuckDB; a query without SQL is named here, with the test that checks its rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import SMALL, connect, rows, sql_rows

CORE = sorted(entry.core.QUERIES)
#: A minimum found step by step: tests/test_operators.py compares it with a fine grid.
NO_SQL = {"temperature_fit": ["nll", "temperature"]}


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    sql = entry.oracle_sql().get(name)
    if sql:
        assert rows(df) == sql_rows(duck, sql)
    else:
        assert sorted(df.columns) == NO_SQL[name] and df.count() == 1


def test_entry(spark):
    assert entry.entry(spark).columns == ["rule", "severity", "record_index", "item", "grp", "first_item", "first_grp"]
