"""Named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def told(df: DataFrame) -> DataFrame:
    """df with doubles rounded to six places and dates as text, as `shown` does in SQL."""
    cols = {c: F.round(c, 6) for c, t in df.dtypes if t == "double"} | {c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"}
    return df.withColumns(cols) if cols else df


def shown(sql: str, floats: str = "", dates: str = "") -> str:
    """sql with the named columns rounded or cast like those of `told`."""
    changes = [f"round({c}, 6) AS {c}" for c in floats.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    head, _, body = sql.strip().rpartition("\n--\n")
    return f"{head}\nSELECT * REPLACE ({', '.join(changes)}) FROM (\n{body}\n)" if changes else sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def _load() -> None:
    from tidewater.plans import conversing, forecasting, reporting, retrieving  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bt_leaderboard"](spark, sf_dir)
