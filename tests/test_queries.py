"""Every core query runs, and equals its SQL, over whole small tables."""

import pytest

from tests.oracle import connect, rows, sql_rows
from vidsift import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = rows(QUERIES[name](spark, FOLDER))
    if name in SQL:
        assert got == sql_rows(con, SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
