"""Every registered query against its SQL, on the smallest tables."""

import pytest

from quernstone.plans import registry
from tests.oracle import connect, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    rows = spark_rows(df)
    if name in SQL:
        names, expected = duck_rows(con, SQL[name])
        assert sorted(df.columns) == names
        assert rows == expected
    else:
        assert rows


def test_entry(spark):
    got = registry.flagship(spark, FOLDER, 10).collect()
    assert len(got) == 30


def test_names_are_consistent():
    assert set(SQL) <= set(QUERIES)
