"""Every registered query runs; where SQL is given, DuckDB must return the same rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check_oracle import compare, duck

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert compare(df.columns, rows, columns, result.fetchall()) in ("", "float~")


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
