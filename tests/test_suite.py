"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from docflow.suite.oracles import ORACLES
from docflow.suite.queries import QUERIES
from check import TABLES, same

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_an_expected_result():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    assert same(got, db.execute(oracle_sql()[name]).df()) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["pi", "filename", "status", "retry_count", "error"]
    assert not df.isEmpty()
