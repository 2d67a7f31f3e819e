"""Every named query against its SQL on the smallest tables; queries without SQL must give rows."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
QUERIES = entry.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables are not available")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
