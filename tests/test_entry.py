import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
NAMES = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]


def value(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(list(v) if hasattr(v, "tolist") else v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got, names = df.collect(), sorted(df.columns)
    sql = entry.oracle_sql().get(name)
    if not sql:
        return
    want = duck.sql(sql)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    left = sorted(tuple(value(r[n]) for n in names) for r in got)
    right = sorted(tuple(value(r[i]) for i in at) for r in want.fetchall())
    assert left == right
