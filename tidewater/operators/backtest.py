"""Expanding-window backtests of closed-form models, and what is made of their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import frames as fr
from tidewater.functions.frames import SERIES
from tidewater.functions.scores import interval_score, pinball, pinball_mirrored, quantile_higher, reversion, smape

HORIZONS = [1, 3, 6, 12]
ERROR = [SERIES, "model", "horizon", "origin", "target", "y_true", "y_pred"]


def closed_forms(horizon: Column, reversions: dict[str, tuple[int, float]], whole: bool = False) -> dict[str, Column]:
    """Forecasts from columns of the origin: the last value, drift, the mean so far, reversion to log means; with whole, reversion only
    where its window is full."""
    out = {
        "naive": F.col("y"),
        "drift": F.col("y") + horizon * F.try_divide(F.col("y") - F.col("_first"), F.col("pos")),
        "historical_mean": F.col("_mean"),
    }
    full = lambda w: F.col("pos") >= (w - 1 if whole else 0)
    return out | {name: F.when(full(w), reversion(F.ln("y"), F.col(f"_log{w}"), horizon, h)) for name, (w, h) in reversions.items()}


def origins(series: DataFrame, initial: int, windows: set[int]) -> DataFrame:
    """Rows with at least `initial` values so far, and what the models need of the past. Frames only look back."""
    past = fr.ordered().rowsBetween(W.unboundedPreceding, 0)
    cols = {"_first": F.first("y").over(past), "_mean": F.avg("y").over(past)}
    cols |= {f"_log{w}": F.avg(F.ln("y")).over(fr.trailing(w)) for w in windows}
    return series.withColumns(cols).filter(F.col("pos") >= initial - 1)


def backtest(
    series: DataFrame, horizons: list[int] = HORIZONS, initial: int = 24, reversions: dict[str, tuple[int, float]] | None = None, whole: bool = False
) -> DataFrame:
    """The error table: model, horizon, origin, target, y_true, y_pred, for all origins whose target is known.

    Per series one sort; the horizons are exploded and joined to their targets by position.
    """
    reversions = reversions if reversions is not None else {"mean_reversion": (36, 12.0)}
    rows = origins(series, initial, {w for w, _ in reversions.values()})
    rows = rows.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    later = series.select(SERIES, F.col("pos").alias("_at"), F.col("date").alias("target"), F.col("y").alias("y_true"))
    rows = rows.withColumn("_at", F.col("pos") + F.col("horizon")).join(later, [SERIES, "_at"])
    forecasts = closed_forms(F.col("horizon"), reversions, whole)
    made = rows.select(SERIES, "horizon", F.col("date").alias("origin"), "target", "y_true", *[c.alias(n) for n, c in forecasts.items()])
    out = made.unpivot([SERIES, "horizon", "origin", "target", "y_true"], list(forecasts), "model", "y_pred").select(*ERROR)
    return out.filter("y_pred IS NOT NULL") if whole else out


def in_cohorts(errors: DataFrame, cohorts: list[tuple[str, str, str, str]]) -> DataFrame:
    """errors with the name of each cohort (name, axis, first, last) they are in: by their origin or by their target."""
    rows = errors.sparkSession.createDataFrame(cohorts, "cohort string, _axis string, _a string, _b string")
    at = F.when(F.col("_axis") == "origin", F.col("origin")).otherwise(F.col("target"))
    return errors.join(F.broadcast(rows), at.between(F.col("_a").cast("date"), F.col("_b").cast("date"))).drop("_axis", "_a", "_b")


def metrics(errors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, MAE, RMSE, MAPE in percent, and MAE over the naive model's (null without one)."""
    by = by or [SERIES]
    e = F.col("y_true") - F.col("y_pred")
    out = errors.groupBy(*by, "model", "horizon").agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(e, F.col("y_true")))) * 100).alias("mape_pct"),
    )
    naive = F.max(F.when(F.col("model") == "naive", F.col("mae"))).over(W.partitionBy(*by, "horizon"))
    return out.withColumn("rel_mae", F.try_divide(F.col("mae"), naive))


def common_origins(errors: DataFrame) -> DataFrame:
    """Errors at origins where every model of the horizon has a forecast."""
    models = errors.groupBy(SERIES, "horizon").agg(F.countDistinct("model").alias("_all"))
    have = errors.groupBy(SERIES, "horizon", "origin").agg(F.countDistinct("model").alias("_n"))
    whole = have.join(models, [SERIES, "horizon"]).filter("_n = _all")
    return errors.join(whole, [SERIES, "horizon", "origin"], "left_semi")


def ensembles(errors: DataFrame, members: list[str], name: str = "ensemble") -> DataFrame:
    """The members' mean where exactly all of them have one forecast each, and the means without each one."""
    some = errors.filter(F.col("model").isin(members))
    got = some.groupBy(SERIES, "horizon", "origin", "target").agg(
        F.countDistinct("model").alias("_m"),
        F.count("*").alias("_n"),
        F.first("y_true").alias("y_true"),
        F.avg("y_pred").alias(name),
        *[F.avg(F.when(F.col("model") != m, F.col("y_pred"))).alias(f"{name}_without_{m}") for m in members],
    )
    whole = got.filter((F.col("_m") == len(members)) & (F.col("_n") == len(members)))
    names = [name, *[f"{name}_without_{m}" for m in members]]
    return whole.unpivot([SERIES, "horizon", "origin", "target", "y_true"], names, "model", "y_pred").select(*ERROR)


def interval_widths(errors: DataFrame, as_of: str | Column, level: float = 0.9, least: int = 20) -> DataFrame:
    """Half-widths: the higher quantile of abs(ln(y / forecast)) over targets known at the cutoff."""
    cutoff = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    known = errors.filter(F.col("target") <= cutoff)
    got = known.groupBy(SERIES, "model", "horizon").agg(
        F.count("*").alias("calibration_n"), F.sort_array(F.collect_list(F.abs(F.ln(F.col("y_true") / F.col("y_pred"))))).alias("_all")
    )
    return got.filter(F.col("calibration_n") >= least).select(
        SERIES, "model", "horizon", "calibration_n", quantile_higher(F.col("_all"), level).alias("half_width")
    )


def interval_evaluation(errors: DataFrame, test_start: str, level: float = 0.9, least: int = 20) -> DataFrame:
    """Coverage, width, pinball losses and interval score from test_start, with widths frozen the day before."""
    widths = interval_widths(errors, F.date_sub(F.lit(test_start).cast("date"), 1), level, least)
    tests = errors.filter(F.col("origin") >= F.lit(test_start).cast("date")).join(widths, [SERIES, "model", "horizon"])
    low, high = F.col("y_pred") * F.exp(-F.col("half_width")), F.col("y_pred") * F.exp("half_width")
    alpha, y = 1 - level, F.col("y_true")
    return tests.groupBy(SERIES, "model", "horizon").agg(
        F.count("*").alias("n"),
        F.first("calibration_n").alias("calibration_n"),
        F.avg(((y >= low) & (y <= high)).cast("double")).alias("coverage"),
        F.avg(high - low).alias("mean_width"),
        F.avg(pinball(y, low, F.lit(alpha / 2))).alias("pinball_low"),
        F.avg(pinball(y, high, F.lit(1 - alpha / 2))).alias("pinball_high"),
        F.avg(interval_score(y, low, high, alpha)).alias("interval_score"),
    )


def calibration_cutoff(errors: DataFrame, share: float = 0.7) -> DataFrame:
    """Of each series, the origin at position min(n - 1, max(1, floor(n * share))) of the distinct origins."""
    distinct = errors.select(SERIES, "origin").distinct()
    w = W.partitionBy(SERIES)
    rows = distinct.withColumns({"_i": F.row_number().over(w.orderBy("origin")) - 1, "_n": F.count("*").over(w)})
    at = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
    return rows.filter(F.col("_i") == at).select(SERIES, F.col("origin").alias("boundary"))


def calibrated(errors: DataFrame, level: float = 0.9, share: float = 0.7) -> DataFrame:
    """Half-widths over the targets known at each series' calibration boundary, of one error or more."""
    return interval_widths(errors.join(calibration_cutoff(errors, share), SERIES), F.col("boundary"), level, 1)


def selected(table: DataFrame) -> DataFrame:
    """The model with the least MAE of each horizon, then RMSE, then name."""
    w = W.partitionBy(SERIES, "horizon").orderBy("mae", "rmse", "model")
    return table.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def best(table: DataFrame, k: int, column: str) -> DataFrame:
    w = W.partitionBy(SERIES, "horizon").orderBy(column, "model")
    return table.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fairness(errors: DataFrame) -> DataFrame:
    """Of each horizon: origins of the first model by name, their ends, those common to all, and whether all agree."""
    models = errors.groupBy(SERIES, "horizon").agg(F.countDistinct("model").alias("models"), F.min("model").alias("first_model"))
    at = errors.groupBy(SERIES, "horizon", "origin").agg(F.countDistinct("model").alias("_n"), F.collect_set("model").alias("_have"))
    rows = at.join(models, [SERIES, "horizon"])
    mine = F.array_contains("_have", F.col("first_model"))
    return rows.groupBy(SERIES, "horizon").agg(
        F.count_if(mine).alias("n_origins"),
        F.min(F.when(mine, F.col("origin"))).alias("first_origin"),
        F.max(F.when(mine, F.col("origin"))).alias("last_origin"),
        F.count_if(F.col("_n") == F.col("models")).alias("common"),
        F.bool_and(F.col("_n") == F.col("models")).alias("all_same"),
    )


def scaled_metrics(errors: DataFrame, scale: DataFrame) -> DataFrame:
    """MASE by the given scale (series_id, scale) and sMAPE on both of its ranges."""
    rows = errors.join(scale, SERIES)
    y, p = F.col("y_true"), F.col("y_pred")
    return rows.groupBy(SERIES, "model", "horizon").agg(
        (F.avg(F.abs(y - p)) / F.first("scale")).alias("mase"), F.avg(smape(y, p)).alias("smape"), F.avg(smape(y, p, 400)).alias("smape_doubled")
    )


def leaderboard(errors: DataFrame, scale: DataFrame, families: dict[str, str] | None = None, default: str = "classical") -> DataFrame:
    """metrics() and scaled_metrics() of every model and horizon with the model's family and its place by MAE, RMSE and name."""
    rows = metrics(errors).join(scaled_metrics(errors, scale), [SERIES, "model", "horizon"])
    family = F.lit(default)
    if families:
        family = F.coalesce(F.create_map(*[F.lit(x) for pair in families.items() for x in pair])[F.col("model")], F.lit(default))
    place = F.row_number().over(W.partitionBy(SERIES, "horizon").orderBy("mae", "rmse", "model"))
    return rows.withColumns({"family": family, "place": place})


def best_of(table: DataFrame, models: list[str]) -> DataFrame:
    """The best of some models, the networks for one, at each horizon by MAE, RMSE and name."""
    return selected(table.filter(F.col("model").isin(models)))


def first_difference_scale(series: DataFrame, rows: int) -> DataFrame:
    """Mean absolute difference of the first values of each series."""
    d = F.abs(F.col("y") - F.lag("y").over(fr.ordered()))
    return series.withColumn("_d", d).filter(F.col("pos") < rows).groupBy(SERIES).agg(F.avg("_d").alias("scale"))


def paired(errors: DataFrame, model: str, base: str) -> DataFrame:
    """Differences of absolute errors of two models at the same origin, target and horizon."""
    keys = [SERIES, "origin", "target", "horizon"]
    side = lambda m, n: errors.filter(F.col("model") == m).select(*keys, F.abs(F.col("y_true") - F.col("y_pred")).alias(n))
    return side(model, "_a").join(side(base, "_b"), keys).select(*keys, (F.col("_a") - F.col("_b")).alias("difference"))


def naive_quantiles(series: DataFrame, horizon: int, levels: list[float]) -> DataFrame:
    """Forecast quantiles at every series' end: the last value with h-step residuals, as log returns and as differences."""
    ahead = F.lag("y", horizon).over(fr.ordered())
    rows = series.withColumns({"_l": F.ln("y") - F.ln(ahead), "_d": F.col("y") - ahead})
    got = rows.groupBy(SERIES).agg(
        F.max_by("y", "date").alias("last"),
        F.percentile("_l", F.array(*map(F.lit, levels))).alias("_lq"),
        F.percentile("_d", F.array(*map(F.lit, levels))).alias("_dq"),
    )
    out = got.select(SERIES, "last", F.posexplode(F.arrays_zip("_lq", "_dq")).alias("_i", "_q"))
    tau = F.element_at(F.array(*map(F.lit, levels)), F.col("_i") + 1)
    return out.select(
        SERIES, tau.alias("tau"), (F.col("last") * F.exp("_q._lq")).alias("by_return"), (F.col("last") + F.col("_q._dq")).alias("by_difference")
    )


def forecast(series: DataFrame, widths: DataFrame, horizons: list[int], reversions: dict[str, tuple[int, float]] | None = None) -> DataFrame:
    """Forecasts after the end of every series, with the interval of their half-widths."""
    reversions = reversions if reversions is not None else {"mean_reversion": (36, 12.0)}
    ends = origins(series, 1, {w for w, _ in reversions.values()}).withColumn("_r", F.row_number().over(W.partitionBy(SERIES).orderBy(F.desc("date"))))
    rows = ends.filter("_r = 1").withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    made = closed_forms(F.col("horizon"), reversions)
    flat = rows.select(SERIES, "horizon", F.expr("add_months(date, horizon)").alias("date"), *[c.alias(n) for n, c in made.items()])
    long = flat.unpivot([SERIES, "horizon", "date"], list(made), "model", "forecast")
    out = long.join(widths.select(SERIES, "model", "horizon", "half_width"), [SERIES, "model", "horizon"], "left")
    return out.withColumns({"low": F.col("forecast") * F.exp(-F.col("half_width")), "high": F.col("forecast") * F.exp("half_width")}).drop("half_width")


def quantile_scores(rows: DataFrame, levels: list[float]) -> DataFrame:
    """Of rows (y, q array by level): both pinball losses, CRPS with and without the factor 2, coverage, width,
    interval score and crossing rate, after the forecast quantiles are sorted for all but the last."""
    tau = F.array(*map(F.lit, levels))
    q = F.array_sort("q")
    crossed = F.exists(F.sequence(F.lit(2), F.size("q")), lambda i: F.element_at(F.col("q"), i) < F.element_at(F.col("q"), i - 1))
    mean = lambda f: F.aggregate(F.zip_with(q, tau, f), F.lit(0.0), lambda a, x: a + x) / len(levels)
    area = F.aggregate(
        F.sequence(F.lit(2), F.lit(len(levels))),
        F.lit(0.0),
        lambda a, i: a
        + (F.element_at(tau, i) - F.element_at(tau, i - 1))
        * (pinball(F.col("y"), F.element_at(q, i), F.element_at(tau, i)) + pinball(F.col("y"), F.element_at(q, i - 1), F.element_at(tau, i - 1)))
        / 2,
    )
    low, high = F.element_at(q, 1), F.element_at(q, len(levels))
    alpha = 1 - (levels[-1] - levels[0])
    return rows.agg(
        F.count("*").alias("n"),
        F.avg(mean(lambda x, t: pinball(F.col("y"), x, t))).alias("pinball"),
        F.avg(mean(lambda x, t: pinball_mirrored(F.col("y"), x, t))).alias("pinball_mirrored"),
        F.avg(area).alias("crps"),
        (F.avg(area) * 2).alias("crps_doubled"),
        F.avg(((F.col("y") >= low) & (F.col("y") <= high)).cast("double")).alias("coverage"),
        F.avg(high - low).alias("width"),
        F.avg(interval_score(F.col("y"), low, high, alpha)).alias("winkler"),
        F.avg(crossed.cast("double")).alias("crossing_rate"),
    )



def origin_evidence(sets: DataFrame) -> DataFrame:
    """Of rows (series_id, name, horizon, origin): each name's origins, those that all names have, their ends, and
    whether every name has the same."""
    names = sets.groupBy(SERIES, "horizon").agg(F.countDistinct("name").alias("_all"))
    at = sets.groupBy(SERIES, "horizon", "origin").agg(F.countDistinct("name").alias("_n")).join(names, [SERIES, "horizon"])
    common = at.groupBy(SERIES, "horizon").agg(
        F.count_if(F.col("_n") == F.col("_all")).alias("common"),
        F.min(F.when(F.col("_n") == F.col("_all"), F.col("origin"))).alias("first_common"),
        F.max(F.when(F.col("_n") == F.col("_all"), F.col("origin"))).alias("last_common"),
        F.bool_and(F.col("_n") == F.col("_all")).alias("all_same"),
    )
    own = sets.groupBy(SERIES, "horizon", "name").agg(F.countDistinct("origin").alias("origins"))
    return own.join(common, [SERIES, "horizon"])


#: Levels of the fine grid of quantiles.
LEVELS_19 = [round(0.05 * i, 2) for i in range(1, 20)]


def level_name(level: float) -> str:
    """The column name of a quantile, q05 for 0.05."""
    return f"q{round(level * 100):02d}"


def extended_summary(errors: DataFrame, by: tuple[str, ...] = ("period",)) -> DataFrame:
    """By series, the columns of `by` (a period, a seed), model and horizon: n, MAE, RMSE, MASE by the mean step of the actual values in order of origin (1
    with a single one), sMAPE on 0..200, and MAE over that of the naive model, which must be there for every group: an error
    says where it is not."""
    keys = [SERIES, *by, "model", "horizon"]
    step = F.abs(F.col("y_true") - F.lag("y_true").over(W.partitionBy(*keys).orderBy("origin")))
    e, size = F.col("y_pred") - F.col("y_true"), F.abs("y_true") + F.abs("y_pred") + 1e-12
    mae = F.avg(F.abs(e))
    scale = F.when(F.count("*") > 1, F.greatest(F.avg("_step"), F.lit(1e-12))).otherwise(1.0)
    out = errors.withColumn("_step", step).groupBy(*keys).agg(
        F.count("*").alias("n"), mae.alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (mae / scale).alias("mase"), F.avg(200 * F.abs(e) / size).alias("smape")
    )
    base = F.max(F.when(F.col("model") == "naive", F.col("mae"))).over(W.partitionBy(SERIES, *by, "horizon"))
    strict = F.when(base.isNull(), F.raise_error(F.concat(F.lit("no naive model at horizon "), F.col("horizon").cast("string"))).cast("double"))
    return out.withColumn("rel_mae", strict.otherwise(F.col("mae") / base))


def quantile_grid_metrics(rows: DataFrame, by: list[str], levels: list[float] = LEVELS_19) -> DataFrame:
    """Of rows (y_true, q array by level) by the given columns: mean pinball loss over the levels, twice its integral over them (an approximation of CRPS
    that says nothing of the tails), and coverage, width and interval score between the first and the last level."""
    tau = F.array(*map(F.lit, levels))
    loss = F.zip_with("q", tau, lambda x, t: pinball(F.col("y_true"), x, t))
    rows = rows.withColumn("_loss", loss)
    n = len(levels)
    steps = F.zip_with(F.slice("_loss", 1, n - 1), F.slice("_loss", 2, n - 1), lambda a, b: (a + b) / 2)
    widths = F.array(*[F.lit(b - a) for a, b in zip(levels, levels[1:], strict=False)])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    y, low, high = F.col("y_true"), F.element_at("q", 1), F.element_at("q", n)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(total("_loss") / n).alias("pinball"),
        F.avg(2 * total(F.zip_with(steps, widths, lambda s, w: s * w))).alias("crps_central"),
        F.avg(((y >= low) & (y <= high)).cast("double")).alias("coverage90"),
        F.avg(high - low).alias("width90"),
        F.avg(interval_score(y, low, high, 1 - (levels[-1] - levels[0]))).alias("interval_score90"),
    )
