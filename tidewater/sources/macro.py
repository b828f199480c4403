"""Monthly frames of many files: which column holds the dates, which the values, and how each file's values become months."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.operators.series import parsed_date
from tidewater.sources.files import read_table

# Names of date columns in order of preference, parts of such names, and points for parts of value columns' names.
DATE_NAMES = "date Date DATE period Period month Month dt DT data Data дата Дата период Период".split()
DATE_PARTS = "date data period month dt дата период".split()
BANNED = "nominal statusxml vol code id count t c cdx percentile25 percentile75 minrate maxrate".split()
BANNED_POINTS, WANTED_POINTS = -100.0, 50.0
POINTS = [(("rate", "curs", "price", "value"), 10.0), (("inflation", "cpi"), 12.0)]


@dataclass(frozen=True)
class Feature:
    """A file's part in the frame. how: mean or volatility of daily values, or the month's last value."""

    name: str
    path: str
    how: str = "last"
    wanted: tuple[str, ...] = ("",)
    extra: tuple[tuple[str, float], ...] = field(default=())


def numeric_columns(table: DataFrame) -> set[str]:
    """Columns of a text table whose values, some at least, are all numbers."""
    seen = table.agg(*[F.struct(F.count(f"`{c}`").alias("all"), F.count(F.expr(f"try_cast(`{c}` AS double)")).alias("fit")).alias(str(i)) for i, c in enumerate(table.columns)]).first()
    return {c for i, c in enumerate(table.columns) if seen[i]["all"] and seen[i]["all"] == seen[i]["fit"]}


def date_column(columns: list[str], numeric: set[str]) -> str:
    """A usual name; else the first column of text whose name has a usual part; else the first of text; else the first."""
    usual = [c for c in DATE_NAMES if c in columns]
    texts = [c for c in columns if c not in numeric]
    likely = [c for c in texts if any(p in c.lower() for p in DATE_PARTS)]
    return [*usual, *likely, *texts, *columns][0]


def value_column(columns: list[str], numeric: set[str], dates: str, feature: Feature) -> str | None:
    """The number column with the most points, the first of equal ones; names with a banned part lose more than any other part gives."""

    def points(name: str) -> float:
        label = name.lower()
        has = lambda parts: any(p in label for p in parts)
        own = [(BANNED, BANNED_POINTS), (feature.wanted, WANTED_POINTS), *POINTS, *[((part,), n) for part, n in feature.extra]]
        return sum(n for parts, n in own if has(parts))

    able = [c for c in columns if c in numeric and c not in (dates, "date")]
    return max(able, key=points, default=None)


def monthly_values(table: DataFrame, feature: Feature) -> DataFrame | None:
    """month and the feature's value of a file's rows that have a date and a number; None if no column holds numbers."""
    numeric = numeric_columns(table)
    dates = date_column(table.columns, numeric)
    value = value_column(table.columns, numeric, dates, feature)
    if value is None:
        return None
    rows = table.select(parsed_date(F.col(f"`{dates}`")).alias("date"), F.expr(f"try_cast(`{value}` AS double)").alias("y")).dropna()
    rows = rows.withColumn("month", F.trunc("date", "month"))
    if feature.how == "volatility":
        # A file's days are one series of a few thousand rows.
        rows = rows.withColumn("y", F.ln("y") - F.ln(F.lag("y").over(W.orderBy("date", "y"))))
        return rows.groupBy("month").agg(F.stddev_samp("y").alias(feature.name)).filter(F.col(feature.name).isNotNull())
    made = F.avg("y") if feature.how == "mean" else F.max_by("y", F.struct("date", "y"))
    return rows.groupBy("month").agg(made.alias(feature.name))


def monthly_frame(spark: SparkSession, features: list[Feature]) -> DataFrame:
    """month and a column for each feature whose file is there, by full outer joins; ValueError if there is none."""
    out = None
    for f in features:
        path = spark._jvm.org.apache.hadoop.fs.Path(f.path)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            continue
        part = monthly_values(read_table(spark, f.path), f)
        if part is not None:
            out = part if out is None else out.join(part, "month", "full_outer")
    if out is None:
        raise ValueError("no file is there")
    return out


def read_macro(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A CSV file of dates and columns of numbers in order of date, nulls kept; ValueError for no rows, bad or repeated dates, or a lacking target."""
    raw = spark.read.option("header", "true").csv(path)
    if target not in raw.columns or "date" not in raw.columns:
        raise ValueError(f"{target} or date is lacking")
    rows = raw.select(F.expr("try_cast(date AS date)").alias("date"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in raw.columns if c != "date"])
    seen = rows.agg(F.count("*").alias("n"), F.count("date").alias("dates"), F.countDistinct("date").alias("distinct")).first()
    if not seen["n"] or seen["dates"] < seen["n"]:
        raise ValueError("no rows, or dates that cannot be read")
    if seen["distinct"] < seen["n"]:
        raise ValueError("a date is repeated")
    return rows.orderBy("date")
