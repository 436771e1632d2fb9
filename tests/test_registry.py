import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from barspark import registry
from check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
SLOW = {"fit_best", "study_metrics_simple"}


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_counterpart_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, db, name):
    ours = entry_module.queries()[name](spark, FOLDER).toPandas()
    sql = entry_module.oracle_sql().get(name)
    if sql is not None:
        assert compare(ours, db.sql(sql).df()) == "ok"
