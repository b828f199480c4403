"""ARMA and ARIMA by conditional least squares, unit root and residual tests, and what is searched and scored with them.

A series is fitted by one task, bounded by its months; Spark deals the series. The sums of squares are conditional on zeros before
the first value, so that likelihoods and forecasts are close to those of a state-space fit but not the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewater.functions.frames import SERIES

# MacKinnon's approximation of the Dickey-Fuller distribution with a constant, and KPSS critical values.
DF_LEAST, DF_MOST, DF_TURN = -18.83, 2.74, -1.61
DF_LOW, DF_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
KPSS_VALUES, KPSS_LEVELS = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


@dataclass
class Fit:
    order: tuple[int, int, int]
    ar: np.ndarray
    ma: np.ndarray
    mean: float  # of the differenced series; 0 if it was differenced
    y: np.ndarray
    residuals: np.ndarray

    @property
    def criteria(self) -> tuple[float, float, float]:
        """AIC, BIC and HQIC of the Gaussian likelihood; the variance counts as a parameter."""
        n = len(self.residuals)
        k = len(self.ar) + len(self.ma) + 1 + (self.order[1] == 0)
        loss = n * (math.log(2 * math.pi * max(float(self.residuals @ self.residuals) / n, 1e-300)) + 1)
        return loss + 2 * k, loss + k * math.log(n), loss + 2 * k * math.log(math.log(n))

    def forecast(self, horizon: int) -> np.ndarray:
        w, e = list(np.diff(self.y, self.order[1]) - self.mean), list(self.residuals)
        for _ in range(horizon):
            w.append(_next(w, e, self.ar, self.ma))
            e.append(0.0)
        ahead = np.array(w[-horizon:]) + self.mean
        for d in range(self.order[1], 0, -1):
            ahead = np.diff(self.y, d - 1)[-1] + np.cumsum(ahead)
        return ahead

    @property
    def stable(self) -> bool:
        return _inside(self.ar)

    @property
    def invertible(self) -> bool:
        return _inside(-self.ma)


def _next(w: list[float], e: list[float], ar: np.ndarray, ma: np.ndarray) -> float:
    return sum(a * w[-i] for i, a in enumerate(ar, 1) if i <= len(w)) + sum(b * e[-j] for j, b in enumerate(ma, 1) if j <= len(e))


def _inside(coefficients: np.ndarray) -> bool:
    """Whether z^p = c1 z^(p-1) + ... has all its roots inside the unit circle."""
    return not len(coefficients) or bool((np.abs(np.roots([1.0, *-np.asarray(coefficients)])) < 1).all())


def _residuals(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    base = w.copy()
    for i, a in enumerate(ar, 1):
        base[i:] -= a * w[:-i]
    if not len(ma):
        return base
    e = np.zeros(len(w) + len(ma))
    back = ma[::-1]
    for t, v in enumerate(base):
        e[t + len(ma)] = v - back @ e[t : t + len(ma)]
    return e[len(ma) :]


def fit(y: np.ndarray, order: tuple[int, int, int], rounds: int = 60) -> Fit | None:
    """The least conditional sum of squares by Levenberg-Marquardt steps from long-autoregression estimates; None if there
    are too few values or nothing finite is found."""
    p, d, q = order
    w = np.diff(np.asarray(y, float), d)
    if len(w) < 3 * (p + q + 1) + 2 or not np.isfinite(w).all():
        return None
    scale = float(w.std()) or 1.0

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        return x[:p], x[p : p + q], float(x[p + q]) * scale if d == 0 else 0.0

    def errors(x: np.ndarray) -> np.ndarray:
        ar, ma, mean = split(x)
        with np.errstate(all="ignore"):
            return _residuals(w - mean, ar, ma) / scale

    x = np.concatenate([_start(w - (w.mean() if d == 0 else 0.0), p, q), [w.mean() / scale] if d == 0 else []])
    e = errors(x)
    if not np.isfinite(e).all() or e @ e > 1e12:
        x[: p + q] = 0.0
        e = errors(x)
    damping = 1e-3
    for _ in range(rounds if len(x) else 0):
        slope = np.column_stack([(errors(x + step) - e) / 1e-6 for step in 1e-6 * np.eye(len(x))])
        left, right = slope.T @ slope, slope.T @ e
        better = False
        while damping < 1e8:
            move = np.linalg.lstsq(left + damping * np.diag(np.diag(left) + 1e-9), -right, rcond=None)[0]
            new = errors(x + move)
            if np.isfinite(new).all() and new @ new < e @ e:
                better = e @ e - new @ new > 1e-10 * (e @ e)
                x, e, damping = x + move, new, max(damping / 10, 1e-9)
                break
            damping *= 10
        if not better:
            break
    if not np.isfinite(e).all():
        return None
    ar, ma, mean = split(x)
    return Fit(order, ar, ma, mean, np.asarray(y, float), e * scale)


def _start(w: np.ndarray, p: int, q: int) -> np.ndarray:
    """Coefficients by regression on lags and on the residuals of a long autoregression."""
    if not p + q:
        return np.zeros(0)
    long = min(max(p, q) + 4, len(w) // 4)
    lagged = np.column_stack([w[long - k : len(w) - k] for k in range(1, long + 1)])
    e = np.concatenate([np.zeros(long), w[long:] - lagged @ np.linalg.lstsq(lagged, w[long:], rcond=None)[0]])
    at = long + q
    columns = [w[at - k : len(w) - k] for k in range(1, p + 1)] + [e[at - k : len(w) - k] for k in range(1, q + 1)]
    x = np.linalg.lstsq(np.column_stack(columns), w[at:], rcond=None)[0]
    return np.clip(x, -0.95, 0.95)


def orders(differences: tuple[int, ...] = (0, 1), most: int = 2) -> list[tuple[int, int, int]]:
    return [(p, d, q) for d in differences for p in range(most + 1) for q in range(most + 1)]


def chosen(y: np.ndarray, candidates: list[tuple[int, int, int]]) -> Fit | None:
    """The fit with the least BIC, the first of equal ones; candidates that cannot be fitted are left out."""
    made = [f for f in (fit(y, o) for o in candidates) if f is not None]
    return min(made, key=lambda f: f.criteria[1], default=None)


def selected_arma(y: np.ndarray, horizon: int) -> np.ndarray | None:
    """An ARMA of the differences, summed back from the last value; of relative changes if there are fewer than 12 differences."""
    y = np.asarray(y, float)
    steps = np.diff(y) if len(y) > 12 else np.diff(y) / y[:-1]
    best = chosen(steps, [o for o in orders((0,)) if o != (0, 0, 0)])
    return None if best is None else y[-1] + np.cumsum(best.forecast(horizon))


def selected_arima(y: np.ndarray, horizon: int) -> np.ndarray | None:
    best = chosen(np.asarray(y, float), [o for o in orders() if o != (0, 0, 0)])
    return None if best is None else best.forecast(horizon)


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square of df > x), by the recursion from one or two degrees up."""
    h = x / 2
    if h <= 0:
        return 1.0
    tail, k = (math.exp(-h), 2) if df % 2 == 0 else (math.erfc(math.sqrt(h)), 1)
    while k < df:
        tail += math.exp(k / 2 * math.log(h) - h - math.lgamma(k / 2 + 1))
        k += 2
    return min(1.0, tail)


def ljung_box(e: np.ndarray, lags: int) -> tuple[float, float]:
    d, n = e - e.mean(), len(e)
    r = np.array([d[k:] @ d[:-k] for k in range(1, lags + 1)]) / (d @ d)
    value = float(n * (n + 2) * (r * r / (n - np.arange(1, lags + 1))).sum())
    return value, chi_square_tail(value, lags)


def jarque_bera(e: np.ndarray) -> tuple[float, float]:
    d = e - e.mean()
    s, k = (d**3).mean() / (d * d).mean() ** 1.5, (d**4).mean() / (d * d).mean() ** 2
    value = float(len(e) / 6 * (s * s + (k - 3) ** 2 / 4))
    return value, chi_square_tail(value, 2)


def arch_lm(e: np.ndarray, lags: int = 12) -> tuple[float, float]:
    """n times R-squared of the squares' regression on their lags; the p-value is of the F statistic's limit, chi-square."""
    s = e * e
    x = np.column_stack([np.ones(len(s) - lags), *[s[lags - k : len(s) - k] for k in range(1, lags + 1)]])
    rest = s[lags:] - x @ np.linalg.lstsq(x, s[lags:], rcond=None)[0]
    centred = s[lags:] - s[lags:].mean()
    value = float(len(rest) * (1 - rest @ rest / (centred @ centred)))
    return value, chi_square_tail(value, lags)


def dickey_fuller(y: np.ndarray) -> tuple[float, float]:
    """The augmented statistic with a constant and its p-value; as many lags, up to 12 (n / 100)^(1/4), as have the least AIC on
    a common sample."""
    n, d = len(y), np.diff(y)
    most = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))

    def regress(lags: int, skip: int) -> tuple[float, float]:
        x = np.column_stack([y[skip:-1], np.ones(len(d) - skip), *[d[skip - k : len(d) - k] for k in range(1, lags + 1)]])
        target = d[skip:]
        beta = np.linalg.lstsq(x, target, rcond=None)[0]
        rest = target - x @ beta
        m, k = x.shape
        aic = m * (math.log(2 * math.pi * float(rest @ rest) / m) + 1) + 2 * k
        error = math.sqrt(float(rest @ rest) / (m - k) * np.linalg.pinv(x.T @ x)[0, 0])
        return aic, float(beta[0]) / error

    lags = min(range(most + 1), key=lambda k: regress(k, most)[0])
    value = regress(lags, lags)[1]
    if value > DF_MOST:
        return value, 1.0
    if value < DF_LEAST:
        return value, 0.0
    z = sum(c * value**i for i, c in enumerate(DF_LOW if value <= DF_TURN else DF_HIGH))
    return value, 0.5 * math.erfc(-z / math.sqrt(2))


def kpss(y: np.ndarray) -> tuple[float, float]:
    """The level statistic with automatic lags, and its p-value between the table's ends."""
    n, e = len(y), y - y.mean()
    cov = lambda k: float(e[k:] @ e[: n - k])
    few = int(n ** (2 / 9))
    level = cov(0) / n + sum(cov(k) / (n / 2) for k in range(1, few + 1))
    slope = sum(k * cov(k) / (n / 2) for k in range(1, few + 1))
    lags = min(n - 1, int(1.1447 * ((slope / level) ** 2) ** (1 / 3) * n ** (1 / 3)))
    spread = (cov(0) + 2 * sum((1 - k / (lags + 1)) * cov(k) for k in range(1, lags + 1))) / n
    value = float((np.cumsum(e) ** 2).sum() / n**2 / spread)
    return value, float(np.interp(value, KPSS_VALUES, KPSS_LEVELS))


def diagnostics(found: Fit) -> dict:
    """Tests of a fit's residuals and of its roots."""
    e = found.residuals
    return {
        "lb_p": ljung_box(e, 12)[1],
        "jb_p": jarque_bera(e)[1],
        "arch_p": arch_lm(e)[1],
        "acf_lag1": float(np.corrcoef(e[1:], e[:-1])[0, 1]),
        "stable": found.stable,
        "invertible": found.invertible,
    }


def stationarity(series: DataFrame) -> DataFrame:
    """series_id, transform, test, statistic, p_value, conclusion of the level, its log, differences and log returns; transforms
    with fewer than ten values are left out."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("date")["y"].to_numpy(float)
        rows = []
        for name, v in {"level": y, "log_level": np.log(y), "diff": np.diff(y), "log_return": np.diff(np.log(y))}.items():
            if len(v) < 10:
                continue
            for kind, (value, p) in {"ADF": dickey_fuller(v), "KPSS": kpss(v)}.items():
                stays = p <= 0.05 if kind == "ADF" else p > 0.05
                rows.append((pdf[SERIES].iloc[0], name, kind, value, p, "stationary" if stays else "non-stationary"))
        return pd.DataFrame(rows, columns=[SERIES, "transform", "test", "statistic", "p_value", "conclusion"])

    return series.groupBy(SERIES).applyInPandas(test, f"{SERIES} string, transform string, test string, statistic double, p_value double, conclusion string")


def search(series: DataFrame, keep: int = 6, least: int = 24) -> DataFrame:
    """series_id, place, p, d, q, criteria, Ljung-Box p-value of the residuals, MAE and RMSE on the last values (a fifth, from 6 to 24) of
    the `keep` candidates with the least BIC, then AIC. Candidates that cannot be fitted are counted in failed."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("date")["y"].to_numpy(float)
        rows, failed = [], 0
        last = max(6, min(24, len(y) // 5))
        for o in [o for o in orders() if o[0] + o[2]] if len(y) >= least else []:
            found = fit(y[:-last], o)
            if found is None:
                failed += 1
                continue
            e = found.forecast(last) - y[-last:]
            aic, bic, hqic = found.criteria
            lags = min(10, len(found.residuals) // 5)
            lb = ljung_box(found.residuals, lags)[1] if lags else 1.0
            rows.append((bic, aic, hqic, *o, lb, float(np.abs(e).mean()), float(np.sqrt((e * e).mean())), found.stable, found.invertible))
        rows.sort(key=lambda r: r[:2])
        names = ["bic", "aic", "hqic", "p", "d", "q", "lb_p", "mae", "rmse", "stable", "invertible"]
        out = pd.DataFrame(rows[:keep], columns=names)
        return out.assign(**{SERIES: pdf[SERIES].iloc[0], "place": np.arange(1, len(out) + 1), "failed": failed})

    return series.groupBy(SERIES).applyInPandas(
        one, f"{SERIES} string, place int, p int, d int, q int, aic double, bic double, hqic double, lb_p double, mae double, rmse double, stable boolean, invertible boolean, failed int"
    )


def classic_models(most: int = 2) -> dict[str, Callable[[np.ndarray, int], np.ndarray | None]]:
    """AR, ARMA and ARIMA of fixed orders by name, on levels."""

    def of(order: tuple[int, int, int]) -> Callable[[np.ndarray, int], np.ndarray | None]:
        return lambda y, h: None if (found := fit(y, order)) is None else found.forecast(h)

    out = {f"AR{p}": of((p, 0, 0)) for p in range(1, most + 1)}
    out |= {f"ARMA({p},{q})": of((p, 0, q)) for p in range(1, most + 1) for q in range(most + 1)}
    return out | {f"ARIMA({p},{d},{q})": of((p, d, q)) for p, d, q in orders((0, 1), most) if p + q}


def expanding(series: DataFrame, models: dict[str, Callable[[np.ndarray, int], np.ndarray | None]], horizons: list[int], initial: int, stride: int = 1) -> DataFrame:
    """The error table of models fitted anew on all values up to each origin: series_id, model, horizon, origin, target, y_true,
    y_pred. Each series and block of 12 origins is a task, with the values up to the block's last target; a model that
    cannot be fitted at an origin has no row there."""
    from pyspark.sql import functions as F

    block = 12 * stride
    n = series.groupBy(SERIES).agg(F.max("pos").alias("_last"))
    blocks = n.select(SERIES, F.explode(F.sequence(F.lit(0), F.floor((F.col("_last") - initial + 1) / block))).alias("_block")).filter("_block >= 0")
    rows = series.join(blocks, SERIES).filter(F.col("pos") < initial + (F.col("_block") + 1) * block + max(horizons))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        y, dates, name = pdf["y"].to_numpy(float), pdf["date"].to_numpy(), pdf[SERIES].iloc[0]
        first = initial - 1 + int(pdf["_block"].iloc[0]) * block
        out = []
        for at in range(first, min(first + block, len(y) - 1), stride):
            ahead = [h for h in horizons if at + h < len(y)]
            for model, forecast in models.items() if ahead else []:
                made = forecast(y[: at + 1], max(ahead))
                if made is not None and np.isfinite(made).all():
                    out += [(name, model, h, dates[at], dates[at + h], y[at + h], float(made[h - 1])) for h in ahead]
        return pd.DataFrame(out, columns=[SERIES, "model", "horizon", "origin", "target", "y_true", "y_pred"])

    return rows.groupBy(SERIES, "_block").applyInPandas(one, f"{SERIES} string, model string, horizon int, origin date, target date, y_true double, y_pred double")


def autocorrelations(values: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Autocorrelations of lags 1 to `lags` with the whole mean and sum of squares, and partial ones by Durbin's recursion."""
    d = values - values.mean()
    r = np.array([d[k:] @ d[: len(d) - k] for k in range(lags + 1)]) / (d @ d)
    partial, phi = [], np.zeros(0)
    for k in range(1, lags + 1):
        last = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
        phi = np.append(phi - last * phi[::-1], last)
        partial.append(last)
    return r[1:], np.array(partial)


def return_lags(series: DataFrame, lags: int = 24) -> DataFrame:
    """series_id, lag, acf, pacf of the log returns."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = np.diff(np.log(pdf.sort_values("date")["y"].to_numpy(float)))
        acf, pacf = autocorrelations(steps, min(lags, len(steps) - 1))
        return pd.DataFrame({SERIES: pdf[SERIES].iloc[0], "lag": np.arange(1, len(acf) + 1), "acf": acf, "pacf": pacf})

    return series.groupBy(SERIES).applyInPandas(one, f"{SERIES} string, lag int, acf double, pacf double")
