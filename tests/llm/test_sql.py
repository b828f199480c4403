"""Queries with SQL against DuckDB over the same tables."""

import duckdb
import pytest

from tests.test_entry import value
from tidewater.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    got, names = df.collect(), sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(tuple(value(r[n]) for n in names) for r in got) == sorted(tuple(value(r[i]) for i in at) for r in want.fetchall())
