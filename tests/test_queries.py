"""Every registered query gives its SQL twin's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return "~" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    result = contract.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in result.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_no_query_lacks_sql():
    own = set(contract.queries()) - set(contract.LLM_QUERIES)
    assert own - set(contract.oracle_sql()) == set()
