"""Every query with an SQL twin against DuckDB on the smallest tables, where they are present."""

import os

import oracle
import pytest

import __spark_entry__

FOLDER = os.environ.get("QUILLON_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, con, name):
    assert oracle.differences(__spark_entry__.queries()[name](spark, FOLDER), con, __spark_entry__.oracle_sql()[name]) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
