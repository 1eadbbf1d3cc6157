"""Every registered query against its SQL twin, and what its plan may contain."""

import datetime
import decimal
import re

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as contract
from tidemark.plans import catalog
from tidemark.plans.oracle_sql import oracle_sql

QUERIES, SQL = catalog.queries(), oracle_sql()
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return connection


def plain(value):
    """A value and its kind; doubles to twelve digits."""
    if isinstance(value, float):
        return "float", f"{value:.12g}"
    if isinstance(value, decimal.Decimal):
        return "decimal", value.normalize()
    if isinstance(value, datetime.datetime):
        return "timestamp", value.replace(tzinfo=None).isoformat()
    return type(value).__name__, value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (repr([plain(r[i]) for i in order]) for r in rows))


# Queries that run jobs while they are built give a plain read.
EAGER = re.compile(r"[rs]\d|g06_erasure$|g07|t01|q11_raw")
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
            "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name, scans", [
    ("q20_orphan_keys", {"lineitem": 8, "orders": 9}),
    ("q25_health", {"lineitem": 9, "orders": 2}),
    ("b04_latest_snapshot", {"events": 3}),
])
def test_fact_scans_stay_few(spark, name, scans):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    for table_name, most in scans.items():
        assert plan.count(f"{table_name}.parquet") <= most, (table_name, plan.count(f"{table_name}.parquet"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    expected = table([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]
    if not EAGER.match(name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert [node for node in UNWANTED if node in plan] == []


def test_entry(spark):
    assert contract.entry(spark).count() == 5


def test_recent_period_reaches_the_scan(spark):
    plan = QUERIES["m02_credit_summary"](spark, SMALL)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(ts\)", text)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz" in text
