"""Windows over ordered series; every window is partitioned by series, so that series spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SERIES, TIME = "series_id", "date"


def ordered() -> WindowSpec:
    return W.partitionBy(SERIES).orderBy(TIME)


def trailing(rows: int) -> WindowSpec:
    """The current row and the rows before it, so many in all."""
    return ordered().rowsBetween(-(rows - 1), 0)


def full(value: Column, over: Column, rows: int) -> Column:
    """over, a window aggregate of value, where its frame holds so many values; null before."""
    return F.when(F.count(value).over(trailing(rows)) == rows, over)


def rolling_mean(value: Column, rows: int) -> Column:
    return full(value, F.avg(value).over(trailing(rows)), rows)


def rolling_std(value: Column, rows: int) -> Column:
    return full(value, F.stddev_samp(value).over(trailing(rows)), rows)


def change(value: Column, rows: int = 1) -> Column:
    return F.try_divide(value, F.lag(value, rows).over(ordered())) - 1


def log_return(value: Column) -> Column:
    return F.ln(value) - F.ln(F.lag(value, 1).over(ordered()))


def filled_back(value: Column) -> Column:
    """The next value at or after a row; it looks ahead, so it serves diagnostics, never a model."""
    return F.first(value, ignorenulls=True).over(ordered().rowsBetween(0, W.unboundedFollowing))
