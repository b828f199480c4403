"""Monthly series: building, checking, features, targets and joins of several series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import frames as fr
from tidewater.functions.frames import SERIES

KEYS = [SERIES, "date", "pos", "y"]


def monthly(rows: DataFrame, series: str, time: str, value: str) -> DataFrame:
    """series_id, date (month start), pos (from 0), y: sums in thousands, to cents."""
    months = rows.groupBy(F.col(series).alias(SERIES), F.trunc(F.col(time).cast("date"), "month").alias("date")).agg(
        F.round(F.sum(value) / 1000, 2).alias("y")
    )
    return numbered(months)


def numbered(months: DataFrame) -> DataFrame:
    return months.withColumn("pos", F.row_number().over(fr.ordered()) - 1).select(*KEYS)


def violations(series: DataFrame) -> DataFrame:
    """series_id, rule, found: rows that break a rule. Rules: null_date, repeated_date, not_positive (null, NaN,
    infinite or at most 0) and gap (the next month is missing)."""
    next_month = F.lead("date").over(fr.ordered())
    seen = series.withColumns(
        {
            "_gap": next_month.isNotNull() & (F.add_months("date", 1) != next_month) & (next_month != F.col("date")),
            "_same": next_month == F.col("date"),
        }
    )
    bad = F.col("y").isNull() | F.isnan("y") | (F.col("y") <= 0) | (F.col("y") == float("inf"))
    counts = seen.groupBy(SERIES).agg(
        F.count_if(F.col("date").isNull()).alias("null_date"),
        F.count_if("_same").alias("repeated_date"),
        F.count_if(bad).alias("not_positive"),
        F.count_if("_gap").alias("gap"),
    )
    rules = ["null_date", "repeated_date", "not_positive", "gap"]
    return counts.unpivot([SERIES], rules, "rule", "found").filter("found > 0")


def require_valid(series: DataFrame) -> DataFrame:
    """series, or ValueError that names the first broken rules."""
    found = violations(series).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r[SERIES]}: {r['rule']} x {r['found']}" for r in found))
    return series


def internal_features(series: DataFrame) -> DataFrame:
    """Level, lags, changes, full-window means, volatility of twelve log returns, level over mean."""
    y = F.col("y")
    step = series.withColumn("_r", fr.log_return(y))
    lags = {f"y{k}": F.lag(y, k).over(fr.ordered()) for k in (1, 2, 12)}
    means = {f"ma{k}": fr.rolling_mean(y, k) for k in (3, 6, 12)}
    out = step.withColumns(lags | means | {"mom1": fr.change(y, 1), "yoy": fr.change(y, 12), "vol12": fr.rolling_std(F.col("_r"), 12)})
    return out.withColumn("y_over_ma12", y / F.col("ma12")).drop("_r")


def lagged_features(series: DataFrame) -> DataFrame:
    """Lags 1, 2, 3, 6, 12 without the current value, means, momenta, and deviations that are 0 until known."""
    y = F.col("y")
    step = series.withColumn("_r", fr.log_return(y))
    cols = {f"lag_{k}": F.lag(y, k).over(fr.ordered()) for k in (1, 2, 3, 6, 12)}
    cols |= {f"rolling_mean_{k}": fr.rolling_mean(y, k) for k in (3, 6, 12)}
    cols |= {f"rolling_std_{k}": F.coalesce(fr.rolling_std(F.col("_r"), k), F.lit(0.0)) for k in (3, 6, 12)}
    cols |= {f"momentum_{k}": fr.change(y, k) for k in (3, 6, 12)}
    return step.withColumns(cols).drop("_r")


def diagnostics(series: DataFrame) -> DataFrame:
    """Difference and log return with 0 at the start, and the twelve-month mean filled back from the future."""
    y = F.col("y")
    rows = series.withColumns(
        {
            "diff": F.coalesce(y - F.lag(y).over(fr.ordered()), F.lit(0.0)),
            "log_return": F.coalesce(fr.log_return(y), F.lit(0.0)),
            "_mean": fr.rolling_mean(y, 12),
        }
    )
    return rows.withColumn("rolling_mean_12", fr.filled_back(F.col("_mean"))).drop("_mean")


def with_lagged(features: DataFrame, macro: DataFrame, lag_months: int = 1) -> DataFrame:
    """features left-joined with macro (date, ...) as it was known: a month's value counts lag_months later."""
    return features.join(macro.withColumn("date", F.add_months("date", lag_months)), "date", "left")


def aligned(tables: list[DataFrame]) -> DataFrame:
    """Full outer join of (date, value...) tables by month."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "date", "full")
    return out


def monthly_daily(days: DataFrame) -> DataFrame:
    """Of daily (series_id, date, value): each month's mean, last value by date, and the deviation of its log returns (by the
    later day); months without a day are rows of nulls."""
    w = fr.ordered()
    known = days.filter("date IS NOT NULL AND value IS NOT NULL")
    returns = known.withColumn("_r", F.ln("value") - F.ln(F.lag("value").over(w))).withColumn("month", F.trunc("date", "month"))
    got = returns.groupBy(SERIES, "month").agg(
        F.avg("value").alias("mean_value"), F.max_by("value", "date").alias("last_value"), F.stddev_samp("_r").alias("volatility")
    )
    span = got.groupBy(SERIES).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = span.select(SERIES, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return every.join(got, [SERIES, "month"], "left")


def direct_targets(series: DataFrame, features: DataFrame, horizons: list[int]) -> DataFrame:
    """features by origin with each horizon's target date, value and log change; targets beyond the end are left out."""
    far = F.explode(F.array(*map(F.lit, horizons)))
    rows = features.withColumn("horizon", far).withColumn("_at", F.col("pos") + F.col("horizon"))
    later = series.select(SERIES, F.col("pos").alias("_at"), F.col("date").alias("target"), F.col("y").alias("y_true"))
    out = rows.join(later, [SERIES, "_at"]).withColumnRenamed("date", "origin")
    return out.withColumn("log_change", F.ln("y_true") - F.ln("y")).drop("_at")


def training_pairs(features: DataFrame, horizons: list[int], columns: list[str]) -> DataFrame:
    """origin, horizon, pairs: how many rows of complete features have their target at or before the origin."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    known = features.withColumn("_n", F.sum(whole.cast("int")).over(fr.ordered().rowsBetween(W.unboundedPreceding, 0)))
    rows = known.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("_at", F.col("pos") - F.col("horizon"))
    upto = known.select(SERIES, F.col("pos").alias("_at"), F.col("_n").alias("pairs"))
    return rows.join(upto, [SERIES, "_at"]).select(SERIES, F.col("date").alias("origin"), "horizon", F.col("pairs").cast("long"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the latest non-null value of right at or before its time: one pass over both, sorted together."""
    both = left.select(key, time, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(key, time, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    )
    w = W.partitionBy(key).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select(key, time, value)


def splits(series: DataFrame, first: float = 0.70, second: float = 0.85, horizon: int = 21, stride: int = 3) -> DataFrame:
    """Rows with their chronological part, and whether they are an origin: every stride-th from the last row
    before a part, with all horizons inside it."""
    n = F.count("*").over(W.partitionBy(SERIES))
    a, b = F.floor(n * first), F.floor(n * second)
    part = F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "validation").otherwise("test")
    start, end = F.when(F.col("pos") < b - 1, a).otherwise(b), F.when(F.col("pos") < b - 1, b).otherwise(n)
    origin = (F.col("pos") >= start - 1) & (F.col("pos") + horizon < end) & (F.pmod(F.col("pos") - (start - 1), F.lit(stride)) == 0)
    return series.withColumn("part", part).withColumn("is_origin", origin)


def log_change_percentiles(series: DataFrame, recent: int = 6) -> DataFrame:
    """The last months' changes in percent, and the share of all months that moved as little, in percent."""
    r = series.withColumn("_r", fr.log_return(F.col("y"))).filter("_r IS NOT NULL")
    share = F.cume_dist().over(W.partitionBy(SERIES).orderBy(F.abs("_r")))
    last = F.row_number().over(W.partitionBy(SERIES).orderBy(F.desc("date")))
    rows = r.withColumns({"percentile": share * 100, "_last": last}).filter(F.col("_last") <= recent)
    return rows.select(SERIES, "date", (F.expm1("_r") * 100).alias("change_pct"), "percentile")


def seasonality(series: DataFrame) -> DataFrame:
    """Lag-12 autocorrelation, deviation of the twelve month means over their mean, and the two verdicts."""
    lagged = series.withColumn("_l", F.lag("y", 12).over(fr.ordered()))
    acf = lagged.groupBy(SERIES).agg(F.corr("y", "_l").alias("acf12"))
    means = series.groupBy(SERIES, F.month("date").alias("m")).agg(F.avg("y").alias("v"))
    spread = means.groupBy(SERIES).agg((F.stddev_samp("v") / F.avg("v")).alias("spread"))
    return acf.join(spread, SERIES).withColumns({"by_acf": F.col("acf12") > 0.2, "by_spread": F.col("spread") > 0.15})


def autocorrelation(series: DataFrame, lags: int) -> DataFrame:
    """Sample autocorrelations of log returns with the whole sample's mean and n in the denominator."""
    r = series.withColumn("_r", fr.log_return(F.col("y"))).filter("_r IS NOT NULL")
    r = r.withColumn("_d", F.col("_r") - F.avg("_r").over(W.partitionBy(SERIES)))
    pairs = r.withColumns({f"p{k}": F.col("_d") * F.lag("_d", k).over(fr.ordered()) for k in range(1, lags + 1)})
    sums = pairs.groupBy(SERIES).agg(F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, lags + 1)])
    long = sums.unpivot([SERIES, "_v"], [f"p{k}" for k in range(1, lags + 1)], "lag", "s")
    return long.select(SERIES, F.substring("lag", 2, 9).cast("int").alias("lag"), (F.col("s") / F.col("_v")).alias("acf"))


# Formats of dates in the order in which they are tried; day before month.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd.MM.yyyy", "MM.yyyy", "yyyy-MM", "yyyy.MM", "dd/MM/yyyy", "MM/dd/yyyy"]


def parsed_date(text):
    """The first format that reads a text gives its date, else what Spark's own cast reads; null if nothing does."""
    raw = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)).cast("date") for f in DATE_FORMATS], F.to_date(raw.try_cast("timestamp")))


def month_difference(later: Column, earlier: Column) -> Column:
    """Calendar months from one date's month to another's."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def previous_month(day: Column) -> Column:
    """The first and the last day of the calendar month before a day's."""
    first = F.add_months(F.trunc(day, "month"), -1)
    return F.struct(first.alias("start"), F.last_day(first).alias("end"))


def named_month(text: Column) -> Column:
    """The first and the last day of a month written as YYYY-MM and nothing else; null for other texts."""
    first = F.when(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.to_date(F.concat(text, F.lit("-01"))))
    return F.when(first.isNotNull(), F.struct(first.alias("start"), F.last_day(first).alias("end")))


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def stamped_day(text: Column, offset: str = "+03:00") -> Column:
    """The local date of an ISO timestamp with just this offset; null for other texts and offsets."""
    pattern = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?" + offset.replace("+", r"\+") + "$"
    return F.when(text.rlike(pattern) & text.try_cast("timestamp").isNotNull(), F.substring(text, 1, 10).try_cast("date"))


def last_rows(series: DataFrame, least: int = 6, most: int = 24, share: int = 5) -> DataFrame:
    """series with is_test: the last values of each, a fifth of them but 6 to 24."""
    n = F.count("*").over(W.partitionBy(SERIES))
    size = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(n / share)))
    back = F.row_number().over(W.partitionBy(SERIES).orderBy(F.desc("date")))
    return series.withColumn("is_test", back <= size)


def last_of_month(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key in a series the last by order; rows equal in both tie and any one stays."""
    w = W.partitionBy(SERIES, key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def windows(series: DataFrame, lookback: int = 12, horizon: int = 21) -> DataFrame:
    """origin, x (log returns of the last `lookback` months) and y (log changes of the next `horizon` months) where both are whole."""
    step = series.withColumn("_r", fr.log_return(F.col("y")))
    ahead = fr.ordered().rowsBetween(1, horizon)
    rows = step.withColumns(
        {"x": F.collect_list("_r").over(fr.trailing(lookback)), "_later": F.collect_list(F.ln("y")).over(ahead)}
    ).filter((F.size("x") == lookback) & (F.size("_later") == horizon))
    return rows.select(SERIES, F.col("date").alias("origin"), "pos", "x", F.transform("_later", lambda v: v - F.ln("y")).alias("y"))


def inner_split(origins: DataFrame, horizon: int, share: float = 0.8) -> DataFrame:
    """origins (series_id, pos, ...) with part: train if the last target lies before the boundary at `share` of the
    origins, validation from the boundary on; what is between is purged (null)."""
    w = W.partitionBy(SERIES)
    rows = origins.withColumns({"_i": F.row_number().over(w.orderBy("pos")) - 1, "_n": F.count("*").over(w)})
    edge = F.min(F.when(F.col("_i") >= F.floor(F.col("_n") * share), F.col("pos"))).over(w)
    part = F.when(F.col("pos") >= edge, "validation").when(F.col("pos") + horizon < edge, "train")
    return rows.withColumn("part", part).drop("_i", "_n")


def return_tests(series: DataFrame, lags: int = 12) -> DataFrame:
    """Ljung-Box statistic of log returns up to so many lags, and Jarque-Bera with its p-value (chi-square, 2)."""
    r = series.withColumn("_r", fr.log_return(F.col("y"))).filter("_r IS NOT NULL")
    n = r.groupBy(SERIES).agg(F.count("*").alias("n"), F.skewness("_r").alias("_s"), F.kurtosis("_r").alias("_k"))
    box = autocorrelation(series, lags).join(n, SERIES).groupBy(SERIES).agg(
        F.sum(F.col("n") * (F.col("n") + 2) * F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("ljung_box")
    )
    jb = F.col("n") / 6 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4)
    return n.join(box, SERIES).select(SERIES, "n", "ljung_box", jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jarque_bera_p"))
