"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.helpers import plan

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

SQL = {k: v for k, v in entry.oracle_sql().items() if k not in entry._llm()[0]} if os.path.isdir(SF_DIR) else {}
TYPES = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}
# Writing sinks or Arrow conversion aside, nothing leaves the JVM.
USES_PYTHON = {"export_arrow", "merged_duration_ordered"}


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{SF_DIR}/{file}'")
    return connection


def test_every_query_has_its_sql():
    own = entry.queries().keys() - entry._llm()[0].keys()
    assert own == SQL.keys()


@pytest.mark.parametrize("name", SQL)
def test_against_duckdb(spark, connection, name):
    df = entry.queries()[name](spark, SF_DIR)
    expected = connection.sql(SQL[name])
    order = [expected.columns.index(c) for c in df.columns]
    assert sorted(expected.columns) == sorted(df.columns)
    assert [TYPES[str(expected.types[i])] for i in order] == [f.dataType.simpleString() for f in df.schema]

    def key(row):
        return tuple((v is None, str(v)) for v in row)

    want = sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=key)
    assert want
    assert sorted((tuple(r) for r in df.collect()), key=key) == want

    text = plan(df)
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert name in USES_PYTHON or "Python" not in text and "InArrow" not in text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["day", "repo", "duration"] and df.count() == 365 * 21
