"""Every registered query against its SQL, on the smallest tables."""

import pytest

from holdfast.plans import catalogue
from tests.oracle import compare, connect, folder

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(folder())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, folder())
    assert name in SQL
    assert compare(db, df, SQL[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 9
    assert set(entry.oracle_sql()) <= set(entry.queries())
