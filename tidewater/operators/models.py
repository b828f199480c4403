"""Fitted models: least squares by windows in Spark, and small numpy fits, a series to a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import frames as fr
from tidewater.functions.frames import SERIES


def ar1(series: DataFrame, initial: int) -> DataFrame:
    """Slope, intercept and one-step forecast of an AR(1) of logs, fitted on all rows up to each origin."""
    past = fr.ordered().rowsBetween(W.unboundedPreceding, 0)
    rows = series.withColumns({"_a": F.ln("y"), "_b": F.ln(F.lag("y").over(fr.ordered()))})
    fit = rows.withColumns({"slope": F.regr_slope("_a", "_b").over(past), "intercept": F.regr_intercept("_a", "_b").over(past)})
    out = fit.filter(F.col("pos") >= initial - 1)
    return out.select(SERIES, "date", "slope", "intercept", F.exp(F.col("intercept") + F.col("slope") * F.col("_a")).alias("forecast"))


def autoregression(y: np.ndarray, lags: int, horizon: int, trend: bool = True) -> np.ndarray:
    """Forecasts of log y from its lags, a constant and a linear trend, by least squares, fed back step by step."""
    z, n = np.log(y), len(y)
    t = np.arange(lags + 1, n + 1)
    columns = [np.ones(n - lags), *([t] if trend else []), *[z[lags - k : n - k] for k in range(1, lags + 1)]]
    beta = np.linalg.lstsq(np.column_stack(columns), z[lags:], rcond=None)[0]
    known, fixed = list(z), 2 if trend else 1
    for step in range(1, horizon + 1):
        x = [1.0, *([n + step] if trend else []), *known[: -lags - 1 : -1]]
        known.append(float(np.dot(beta[:fixed], x[:fixed]) + np.dot(beta[fixed:], x[fixed:])))
    return np.exp(known[n:])


def chosen_lags(y: np.ndarray, most: int = 4) -> int:
    """The number of lags with the least BIC of a regression with a constant on a common sample."""
    z, best = np.log(y), (np.inf, 1)
    for p in range(1, most + 1):
        x = np.column_stack([np.ones(len(z) - most), *[z[most - k : len(z) - k] for k in range(1, p + 1)]])
        rest = z[most:] - x @ np.linalg.lstsq(x, z[most:], rcond=None)[0]
        n = len(rest)
        best = min(best, (n * np.log(rest @ rest / n) + (p + 1) * np.log(n), p))
    return best[1]


def holt(y: np.ndarray, horizon: int, damped: bool = False) -> np.ndarray:
    """Additive trend smoothing; the weights of least squared one-step errors on a grid."""
    best = (np.inf, y[-1], 0.0, 1.0)
    for a in np.linspace(0.1, 1.0, 10):
        for b in np.linspace(0.0, 0.5, 6):
            for phi in (0.8, 0.9, 0.98) if damped else (1.0,):
                level, trend, loss = y[0], y[1] - y[0], 0.0
                for v in y[1:]:
                    error = v - (level + phi * trend)
                    loss += error * error
                    level, trend = level + phi * trend + a * error, phi * trend + a * b * error
                best = min(best, (loss, level, trend, phi))
    _, level, trend, phi = best
    return level + np.cumsum(phi ** np.arange(1, horizon + 1)) * trend


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """Ridge regression on columns of mean 0 and population deviation 1; the intercept is not shrunk."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale == 0, 1, scale)
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda new: (new - mean) / scale @ beta + y.mean()


def quantile_regression(x: np.ndarray, y: np.ndarray, tau: float, rounds: int = 500) -> np.ndarray:
    """Coefficients, constant first, by iteratively reweighted least squares."""
    z = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    for _ in range(rounds):
        rest = y - z @ beta
        w = np.where(rest > 0, tau, 1 - tau) / np.maximum(np.abs(rest), 1e-6)
        new = np.linalg.lstsq(z * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        if np.abs(new - beta).max() < 1e-9:
            break
        beta = new
    return beta


def isotonic(values: np.ndarray) -> np.ndarray:
    """The nearest rising sequence by squares: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for v in values:
        pools.append([float(v), 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    return np.concatenate([np.full(int(n), v) for v, n in pools]) if pools else np.zeros(0)


def _series_forecasts(horizon: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("date")["y"].to_numpy()
        made = {f"ar_{p}": autoregression(y, p, horizon) for p in (1, 3, 6, 12) if len(y) > 3 * p + 3}
        made["selected_ar"] = autoregression(y, chosen_lags(y), horizon, trend=False)
        made |= {"holt_additive": holt(y, horizon), "holt_damped": holt(y, horizon, True), "ets_log": np.exp(holt(np.log(y), horizon, True))}
        parts = [pd.DataFrame({SERIES: pdf[SERIES].iloc[0], "model": m, "horizon": np.arange(1, horizon + 1), "forecast": f}) for m, f in made.items()]
        return pd.concat(parts)

    return fit


def fitted_forecasts(series: DataFrame, horizon: int = 12) -> DataFrame:
    """series_id, model, horizon, forecast of the numpy models; a series is one group, bounded by its months."""
    return series.groupBy(SERIES).applyInPandas(_series_forecasts(horizon), f"{SERIES} string, model string, horizon int, forecast double")


def ridge_direct(records: DataFrame, columns: list[str], least_pairs: int = 24) -> DataFrame:
    """Direct forecasts: for each series and horizon, ridge of the log target on the origin's features over all
    pairs whose target is known at the last origin; applied to that origin."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("origin")
        x, y = pdf[columns].to_numpy(float), pdf["y_true"].to_numpy(float)
        last = pdf.iloc[-1]
        known = np.isfinite(x).all(1) & np.isfinite(y) & (pdf["target"] <= last["origin"]).to_numpy()
        row = {SERIES: last[SERIES], "horizon": int(last["horizon"]), "pairs": int(known.sum()), "forecast": None}
        if known.sum() >= least_pairs and np.isfinite(x[-1]).all():
            row["forecast"] = float(np.exp(ridge(x[known], np.log(y[known]))(x[-1:])[0]))
        return pd.DataFrame([row])

    return records.groupBy(SERIES, "horizon").applyInPandas(fit, f"{SERIES} string, horizon int, pairs long, forecast double")


def quantile_autoregression(series: DataFrame, horizon: int, levels: list[float], lags: tuple[int, ...] = (0, 1, 2, 11)) -> DataFrame:
    """series_id, tau, forecast: quantiles of the value `horizon` months after the end of each series, by linear quantile regressions of the log change
    on the log returns so many months back, rising by level. Series with fewer than 24 pairs have none."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.log(pdf.sort_values("date")["y"].to_numpy(float))
        step = np.diff(y)
        at = np.arange(max(lags), len(step))
        x = np.column_stack([step[at - k] for k in lags])
        known = at + 1 + horizon < len(y)
        made = []
        if known.sum() >= 24:
            change = y[at[known] + 1 + horizon] - y[at[known] + 1]
            beta = [quantile_regression(x[known], change, t) for t in levels]
            made = isotonic(np.array([b[0] + x[-1] @ b[1:] for b in beta]))
        return pd.DataFrame({SERIES: pdf[SERIES].iloc[0], "tau": levels[: len(made)], "forecast": np.exp(y[-1] + np.asarray(made, float))})

    return series.groupBy(SERIES).applyInPandas(fit, f"{SERIES} string, tau double, forecast double")


#: Resamples' random starts: the first eight hexadecimal digits of MD5 of seed, resample and block, modulo the number of values.
SEED = "blocks-1"


def bootstrap_intervals(differences: DataFrame, block_of_horizon: bool = True, samples: int = 2000, seed: str = SEED) -> DataFrame:
    """Per series and horizon: n, the mean difference, and the 2.5 and 97.5 % points of the means of resamples made of circular blocks (null with
    fewer than four blocks of values). Blocks are as long as the horizon, or one value.

    A block's sum is the difference of two prefix sums of the values in order of origin, written twice in a row; a resample is its
    blocks' sums, the last block cut so that it has n values. DataFrame operations only; resamples are rows.
    """
    length = F.col("horizon") if block_of_horizon else F.lit(1)
    line = F.transform(F.array_sort(F.collect_list(F.struct("origin", "difference"))), lambda x: x["difference"])
    rows = differences.groupBy(SERIES, "horizon").agg(F.count("*").alias("n"), F.avg("difference").alias("mean"), line.alias("_d"))
    twice = F.concat("_d", "_d")
    sums = F.aggregate(twice, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    rows = rows.withColumns({"_sums": sums, "_l": length, "_k": F.ceil(F.col("n") / length).cast("int")}).drop("_d")
    whole = rows.filter(F.col("n") >= 4 * F.col("_l"))
    drawn = whole.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))

    def block(k: Column) -> Column:
        digits = F.substring(F.md5(F.concat_ws(" ", F.lit(seed), F.col("_s").cast("string"), k.cast("string"))), 1, 8)
        start = F.pmod(F.conv(digits, 16, 10).cast("long"), F.col("n")).cast("int")
        size = F.least(F.col("_l"), F.col("n") - k * F.col("_l")).cast("int")
        return F.element_at("_sums", start + size + 1) - F.element_at("_sums", start + 1)

    total = F.aggregate(F.sequence(F.lit(0), F.col("_k") - 1), F.lit(0.0), lambda acc, k: acc + block(k))
    ends = drawn.withColumn("_m", total / F.col("n")).groupBy(SERIES, "horizon").agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_ends"))
    return rows.select(SERIES, "horizon", "n", "mean").join(ends, [SERIES, "horizon"], "left").select(
        SERIES, "horizon", "n", "mean", F.get("_ends", 0).alias("low"), F.get("_ends", 1).alias("high")
    )
