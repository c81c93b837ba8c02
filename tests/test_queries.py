"""Every dosimetry query against its SQL."""

import pytest
from compare import DATA, connect, same

from voxdose.plans import oracle, queries

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_all_have_sql():
    assert set(SQL) == set(queries.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    same(con, queries.queries()[name](spark, DATA), SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
