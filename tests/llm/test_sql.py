"""Each query that has SQL against it, over the same files."""

import os
from pathlib import Path

import duckdb
import pytest

from tillwise.llm.registry import llm_queries, llm_sql

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query(spark, name):
    database = duckdb.connect()
    for file in sorted(Path(FOLDER).glob("*.parquet")):
        database.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = llm_queries()[name](spark, FOLDER)
    expected = database.sql(llm_sql()[name])
    names = sorted(result.columns)
    assert names == sorted(expected.columns)
    got = sorted(tuple(row[n] for n in names) for row in result.collect())
    order = [list(expected.columns).index(n) for n in names]
    assert got == sorted(tuple(row[i] for i in order) for row in expected.fetchall())
