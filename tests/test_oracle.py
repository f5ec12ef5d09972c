"""Every catalog query against its SQL, value by value, on the smallest driver tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from marginlens.plans.catalog import CATALOG
from oracle import ORACLES
from tests.conftest import TESTDATA

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
TYPES = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "bigint": "BIGINT", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS FROM '{TESTDATA}/sf0.001/{table}.parquet'")
    return connection


def sorted_rows(rows, columns, order):
    positions = [columns.index(c) for c in order]
    picked = [tuple(row[p] for p in positions) for row in rows]
    return sorted(picked, key=lambda row: [(v is None, str(v)) for v in row])


def test_every_query_has_an_oracle():
    assert set(CATALOG) == set(ORACLES)
    assert set(CATALOG) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CATALOG)
def test_query_equals_oracle(spark, engine, name):
    result = entry.queries()[name](spark, f"{TESTDATA}/sf0.001")
    reply = engine.execute(ORACLES[name])
    columns, types = [c[0] for c in reply.description], {c[0]: str(c[1]) for c in reply.description}
    order = sorted(columns)
    assert sorted(result.columns) == order
    assert {c: TYPES[t] for c, t in result.dtypes} == types
    assert sorted_rows(result.collect(), result.columns, order) == sorted_rows(reply.fetchall(), columns, order)


def test_flagship_runs(spark):
    assert [r["ord"] for r in entry.entry(spark).collect()] == list(range(9))
