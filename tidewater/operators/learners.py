"""Boosted trees and small networks in numpy, for the few hundred rows of a series; one series to a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewater.functions.frames import SERIES
from tidewater.operators.models import isotonic

LEVELS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


class Tree:
    """A regression tree on columns in sorted order: every split is that of the least sum of squares of the target."""

    def __init__(self, x: np.ndarray, target: np.ndarray, depth: int, least: int, leaf: Callable[[np.ndarray], float]):
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self._grow(x, target, np.arange(len(x)), depth, least, leaf)

    def _grow(self, x: np.ndarray, target: np.ndarray, rows: np.ndarray, depth: int, least: int, leaf: Callable) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0, leaf(rows)))
        split = _best_split(x[rows], target[rows], least) if depth else None
        if split:
            column, edge = split
            low = x[rows, column] <= edge
            left = self._grow(x, target, rows[low], depth - 1, least, leaf)
            right = self._grow(x, target, rows[~low], depth - 1, least, leaf)
            self.nodes[at] = (column, edge, left, right, 0.0)
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(x)), np.zeros(len(x), np.int64)
        column, edge, left, right, value = (np.array(c) for c in zip(*self.nodes, strict=True))
        live = np.arange(len(x))
        while len(live):
            c = column[at[live]]
            done = c < 0
            out[live[done]] = value[at[live[done]]]
            live, c = live[~done], c[~done]
            at[live] = np.where(x[live, c] <= edge[at[live]], left[at[live]], right[at[live]])
        return out


def _best_split(x: np.ndarray, target: np.ndarray, least: int) -> tuple[int, float] | None:
    n = len(x)
    if n < 2 * least:
        return None
    order = np.argsort(x, axis=0, kind="stable")
    line, sums = np.take_along_axis(x, order, 0), np.cumsum(target[order], axis=0)
    k = np.arange(1, n)[:, None]
    # Largest between-group sum of squares; a border between equal values is none.
    gain = sums[:-1] ** 2 / k + (sums[-1] - sums[:-1]) ** 2 / (n - k)
    gain[(line[1:] == line[:-1]) | (k < least) | (n - k < least)] = -np.inf
    at, column = np.unravel_index(gain.argmax(), gain.shape)
    if gain[at, column] <= sums[-1, 0] ** 2 / n + 1e-12:
        return None
    return int(column), float((line[at, column] + line[at + 1, column]) / 2)


def boosted(
    x: np.ndarray, y: np.ndarray, tau: float | None = None, rounds: int = 200, rate: float = 0.05, depth: int = 3, least: int = 5
) -> Callable[[np.ndarray], np.ndarray]:
    """Gradient boosting of trees: squares, or the quantile loss of level tau, whose leaves are quantiles of the residuals."""
    point = (lambda v: float(v.mean())) if tau is None else (lambda v: float(np.quantile(v, tau)))
    first = point(y)
    now, trees = np.full(len(y), first), []
    for _ in range(rounds):
        rest = y - now
        slope = rest if tau is None else np.where(rest > 0, tau, tau - 1)
        trees.append(Tree(x, slope, depth, least, lambda rows, rest=rest: point(rest[rows])))
        now = now + rate * trees[-1](x)
    return lambda new: first + rate * sum(t(new) for t in trees)


def network(
    x: np.ndarray, y: np.ndarray, levels: list[float] | None = None, hidden: int = 8, rounds: int = 160, rate: float = 0.01, seed: int = 0, share: float = 0.8, patience: int = 20
) -> Callable[[np.ndarray], np.ndarray]:
    """One hidden layer of tanh units from windows x to all horizons y, by Adam on whole batches; with levels, that many
    quantiles of each horizon under the mean pinball loss. Rows are in order of time: the last ones stop the training early, and windows that
    would see them are the caller's to purge. Predictions are (rows, horizons) or (rows, horizons, levels), the latter rising."""
    r = np.random.default_rng(seed)
    mean, scale = x.mean(0), np.where(x.std(0) == 0, 1, x.std(0))
    centre, spread = y.mean(0), np.where(y.std(0) == 0, 1, y.std(0))
    k = len(levels or [0])
    tau = np.array(levels or [0.5])
    z, t = (x - mean) / scale, ((y - centre) / spread)[:, :, None]
    cut = max(1, int(len(z) * share))
    shape = (hidden, y.shape[1] * k)
    weights = [r.normal(size=(x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), r.normal(size=shape) / np.sqrt(hidden), np.zeros(shape[1])]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]

    def forward(rows: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        inner = np.tanh(rows @ w[0] + w[1])
        return inner, (inner @ w[2] + w[3]).reshape(len(rows), y.shape[1], k)

    def loss(error: np.ndarray) -> float:
        return float((error * error).mean() if levels is None else np.maximum(tau * error, (tau - 1) * error).mean())

    best, kept, wait = np.inf, [w.copy() for w in weights], 0
    for step in range(1, rounds + 1):
        inner, out = forward(z[:cut], weights)
        error = t[:cut] - out
        slope = (-2 * error if levels is None else np.where(error > 0, -tau, 1 - tau)) / error.size
        flat = slope.reshape(cut, -1)
        back = flat @ weights[2].T * (1 - inner * inner)
        for i, g in enumerate((z[:cut].T @ back, back.sum(0), inner.T @ flat, flat.sum(0))):
            m, v = moments[i]
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            weights[i] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        rest = slice(cut, None) if cut < len(z) else slice(0, cut)
        now = loss(t[rest] - forward(z[rest], weights)[1])
        if now < best - 1e-9:
            best, kept, wait = now, [w.copy() for w in weights], 0
        else:
            wait += 1
            if wait >= patience:
                break

    def predict(new: np.ndarray) -> np.ndarray:
        out = forward((new - mean) / scale, kept)[1] * spread[:, None] + centre[:, None]
        return out[:, :, 0] if levels is None else np.apply_along_axis(isotonic, 2, out)

    return predict


def boosted_direct(records: DataFrame, columns: list[str], levels: list[float] | None = None, least_pairs: int = 60) -> DataFrame:
    """Direct forecasts by boosting: for each series and horizon, of the log target on the origin's features over all pairs whose
    target is known at the last origin, applied to that origin. forecasts has the mean's exponential, or a value for each level, rising;
    null with fewer than least_pairs pairs or a feature missing at the last origin."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("origin")
        x, y, last = pdf[columns].to_numpy(float), pdf["y_true"].to_numpy(float), pdf.iloc[-1]
        known = np.isfinite(x).all(1) & np.isfinite(y) & (pdf["target"] <= last["origin"]).to_numpy()
        made = None
        if known.sum() >= least_pairs and np.isfinite(x[-1]).all():
            made = [float(np.exp(boosted(x[known], np.log(y[known]), tau)(x[-1:])[0])) for tau in levels or [None]]
            made = sorted(made) if levels else made
        return pd.DataFrame([{SERIES: last[SERIES], "horizon": int(last["horizon"]), "pairs": int(known.sum()), "forecasts": made}])

    return records.groupBy(SERIES, "horizon").applyInPandas(fit, f"{SERIES} string, horizon int, pairs long, forecasts array<double>")


def network_forecasts(windows: DataFrame, levels: list[float] | None = None, seeds: tuple[int, ...] = (0, 1, 2), purge: int = 21) -> DataFrame:
    """series_id, seed, horizon, forecasts: of the last window (origin, pos, last, x, y) of each series, by a network for each seed that learns from
    windows whose targets end before that origin; targets y are log changes from `last`, and windows without them can only be forecast."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        end, horizon = pdf.iloc[-1], max(len(v) for v in pdf["y"])
        train = pdf[(pdf["pos"] + horizon <= end["pos"]) & (pdf["y"].map(len) == horizon)]
        out = []
        if len(train) >= 24:
            x, y = np.stack(train["x"].to_list()), np.stack(train["y"].to_list())
            for seed in seeds:
                made = network(x, y, levels, seed=seed)(np.asarray(end["x"], float)[None])[0]
                made = made[:, None] if levels is None else made
                out += [(end[SERIES], seed, h, (float(end["last"]) * np.exp(v)).tolist()) for h, v in enumerate(made, 1)]
        return pd.DataFrame(out, columns=[SERIES, "seed", "horizon", "forecasts"])

    return windows.groupBy(SERIES).applyInPandas(fit, f"{SERIES} string, seed int, horizon int, forecasts array<double>")
