"""Every catalogued query against its SQL on the benchmark tables."""

import os

import pytest
from oracle import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from tidewatch.catalog import QUERIES

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert name in oracle_sql()
    assert difference(queries()[name](spark, FOLDER), oracle_sql()[name], con) is None


def test_entry_has_rows(spark):
    df = entry(spark)
    assert {"user_id", "tag_name", "ts"} <= set(df.columns)
    assert not df.isEmpty()
