"""Every registered query against its SQL over the same parquet files."""

import datetime as dt
import math
import os
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from tillwise.registry.oracle import all_sql as oracle_sql
from tillwise.registry.queries import all_queries as queries

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in sorted(Path(FOLDER).glob("*.parquet")):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"int {value}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"float {value!r}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, database, name):
    result = queries()[name](spark, FOLDER)
    expected = database.sql(oracle_sql()[name])
    assert sorted(result.columns) == sorted(expected.columns)
    got = _rows(result.columns, result.collect())
    want = _rows(expected.columns, expected.fetchall())
    assert len(got) == len(want)
    assert [pair for pair in zip(got, want) if pair[0] != pair[1]][:5] == []
    assert got


SORTED = [
    "top_referrers",
    "top_discounts",
    "top_discounts_by_uses",
    "top_products_revenue",
    "top_tags_quantity",
    "top_customers",
    "customers_by_state",
    "city_orders",
    "state_revenue",
    "rfm_top_customers",
    "top_returned_qty",
    "top_return_rate",
    "top_return_comments",
]


@pytest.mark.parametrize("name", SORTED)
def test_order_of_rows(spark, database, name):
    result = queries()[name](spark, FOLDER)
    expected = database.sql(oracle_sql()[name])
    order = [list(expected.columns).index(column) for column in result.columns]
    want = [tuple(_cell(row[i]) for i in order) for row in expected.fetchall()]
    assert [tuple(_cell(value) for value in row) for row in result.collect()] == want


def test_entry(spark):
    assert entry(spark).count() > 0
