"""Queries over the monthly series of orders, one series for each priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import frames as fr
from tidewater.operators import backtest as bt
from tidewater.operators import series as se
from tidewater.plans.catalog import query, shown, told
from tidewater.session import table

START = "2000-01-01"
LEVELS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
GRID = {f"mr_{w}_{int(h)}": (w, h) for w in (12, 24, 36) for h in (6.0, 12.0, 24.0)}


def series(spark, sf) -> DataFrame:
    return se.monthly(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")


def errors(spark, sf) -> DataFrame:
    return bt.backtest(series(spark, sf))


def macro(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date"))
    return lines.agg(F.round(F.sum("l_quantity"), 2).cast("double").alias("quantity"))


S = """
WITH m AS (
  SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS date, round(sum(o_totalprice) / 1000, 2) AS y
  FROM orders GROUP BY ALL),
s AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, y FROM m)"""

E = (
    S
    + """,
o AS (
  SELECT *, first(y) OVER p AS f, avg(y) OVER p AS mean_y,
         avg(ln(y)) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS l36
  FROM s WINDOW p AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT o.*, horizon FROM o, (SELECT unnest([1, 3, 6, 12]) AS horizon) WHERE pos >= 23),
j AS (
  SELECT h.series_id, h.horizon, h.date AS origin, t.date AS target, t.y AS y_true, h.y AS naive,
         h.y + h.horizon * ((h.y - h.f) / h.pos) AS drift, h.mean_y AS historical_mean,
         exp(l36 + (ln(h.y) - l36) * exp(h.horizon * (-ln(2) / 12.0))) AS mean_reversion
  FROM h JOIN s t ON t.series_id = h.series_id AND t.pos = h.pos + h.horizon),
e AS (
  SELECT series_id, model, horizon, origin, target, y_true, y_pred
  FROM (UNPIVOT j ON naive, drift, historical_mean, mean_reversion INTO NAME model VALUE y_pred))"""
)

METRICS = """
SELECT *, mae / nullif(max(mae) FILTER (model = 'naive') OVER (PARTITION BY series_id, horizon), 0) AS rel_mae
FROM (
  SELECT series_id, model, horizon, count(*) AS n, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) ** 2)) AS rmse,
         avg(abs((y_true - y_pred) / y_true)) * 100 AS mape_pct
  FROM {0} GROUP BY ALL)"""
MF = "mae rmse mape_pct rel_mae"


@query(shown(S + "\n--\nSELECT * FROM s", "y", "date"))
def monthly_series(spark, sf):
    return told(series(spark, sf))


@query(
    shown(
        """WITH d AS (SELECT user_id % 3 AS series_id, ts::DATE AS date, value AS y, event_id FROM events),
g AS (SELECT *, lead(date) OVER (PARTITION BY series_id ORDER BY date, event_id) AS nxt FROM d)
--
SELECT series_id, rule, found FROM (
  SELECT series_id, 'repeated_date' AS rule, count_if(nxt = date) AS found FROM g GROUP BY 1
  UNION ALL SELECT series_id, 'not_positive', count_if(y IS NULL OR isnan(y) OR y <= 0 OR isinf(y)) FROM g GROUP BY 1
  UNION ALL SELECT series_id, 'gap', count_if(nxt IS NOT NULL AND nxt <> date AND (date + INTERVAL 1 MONTH)::DATE <> nxt) FROM g GROUP BY 1
) WHERE found > 0"""
    ).replace("\n--\n", "\n")
)
def series_violations(spark, sf):
    e = table(spark, sf, "events")
    return se.violations(e.select((F.col("user_id") % 3).alias("series_id"), F.col("ts").cast("date").alias("date"), F.col("value").alias("y")))


def _full(f: str, value: str, k: int) -> str:
    w = f"OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) {w} = {k} THEN {f}({value}) {w} END"


LAG = "lag(y, {0}) OVER (PARTITION BY series_id ORDER BY date)"
R = S + f", r AS (SELECT *, ln(y) - ln({LAG.format(1)}) AS r FROM s)"


@query(
    shown(
        R
        + f"""
--
SELECT series_id, date, pos, y, {', '.join(f'{LAG.format(k)} AS y{k}' for k in (1, 2, 12))},
  {', '.join(f'{_full("avg", "y", k)} AS ma{k}' for k in (3, 6, 12))}, y / {LAG.format(1)} - 1 AS mom1, y / {LAG.format(12)} - 1 AS yoy,
  {_full("stddev_samp", "r", 12)} AS vol12, y / {_full("avg", "y", 12)} AS y_over_ma12 FROM r""",
        "y y1 y2 y12 ma3 ma6 ma12 mom1 yoy vol12 y_over_ma12",
        "date",
    )
)
def feat_internal(spark, sf):
    return told(se.internal_features(series(spark, sf)))


@query(
    shown(
        R
        + f"""
--
SELECT series_id, date, pos, y, {', '.join(f'{LAG.format(k)} AS lag_{k}' for k in (1, 2, 3, 6, 12))},
  {', '.join(f'{_full("avg", "y", k)} AS rolling_mean_{k}, coalesce({_full("stddev_samp", "r", k)}, 0) AS rolling_std_{k}, y / {LAG.format(k)} - 1 AS momentum_{k}' for k in (3, 6, 12))}
FROM r""",
        "y " + " ".join(f"lag_{k}" for k in (1, 2, 3, 6, 12)) + " " + " ".join(f"{n}_{k}" for n in ("rolling_mean", "rolling_std", "momentum") for k in (3, 6, 12)),
        "date",
    )
)
def feat_lagged(spark, sf):
    return told(se.lagged_features(series(spark, sf)))


@query(
    shown(
        R
        + f""", f AS (SELECT *, {_full("avg", "y", 12)} AS m12 FROM r)
--
SELECT series_id, date, pos, y, coalesce(y - {LAG.format(1)}, 0) AS diff, coalesce(r, 0) AS log_return,
  first(m12 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rolling_mean_12
FROM f""",
        "y diff log_return rolling_mean_12",
        "date",
    )
)
def feat_diagnostics(spark, sf):
    return told(se.diagnostics(series(spark, sf)))


Q = "q AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, round(sum(l_quantity), 2)::DOUBLE AS quantity FROM lineitem GROUP BY 1)"


@query(shown(S + f", {Q}\n--\nSELECT s.*, q.quantity FROM s LEFT JOIN q ON s.date = (q.date + INTERVAL 1 MONTH)::DATE", "y quantity", "date"))
def macro_lag_join(spark, sf):
    return told(se.with_lagged(series(spark, sf), macro(spark, sf), 1))


@query(
    shown(
        f"""WITH {Q}, a AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, count(*) AS orders FROM orders GROUP BY 1),
b AS (SELECT date_trunc('month', ts)::DATE AS date, count(*) AS events FROM events GROUP BY 1)
--
SELECT coalesce(a.date, q.date, b.date) AS date, orders, quantity, events
FROM a FULL JOIN q ON a.date = q.date FULL JOIN b ON coalesce(a.date, q.date) = b.date""",
        "quantity",
        "date",
    )
)
def full_outer_months(spark, sf):
    month = lambda c: F.trunc(F.col(c).cast("date"), "month").alias("date")
    a = table(spark, sf, "orders").groupBy(month("o_orderdate")).agg(F.count("*").alias("orders"))
    b = table(spark, sf, "events").groupBy(month("ts")).agg(F.count("*").alias("events"))
    return told(se.aligned([a, macro(spark, sf), b]))


@query(
    shown(
        """WITH d AS (SELECT o_orderstatus AS series_id, o_orderdate::DATE AS date, round(sum(o_totalprice) / 1000, 2) AS value FROM orders GROUP BY ALL),
r AS (SELECT *, ln(value) - ln(lag(value) OVER (PARTITION BY series_id ORDER BY date)) AS r, date_trunc('month', date)::DATE AS month FROM d),
g AS (SELECT series_id, month, avg(value) AS mean_value, arg_max(value, date) AS last_value, stddev_samp(r) AS volatility FROM r GROUP BY ALL),
e AS (SELECT series_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM g GROUP BY 1)
--
SELECT e.series_id, e.month, mean_value, last_value, volatility FROM e LEFT JOIN g ON g.series_id = e.series_id AND g.month = e.month""",
        "mean_value last_value volatility",
        "month",
    )
)
def daily_to_monthly(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("series_id"), F.col("o_orderdate").cast("date").alias("date"))
    return told(se.monthly_daily(o.agg(F.round(F.sum("o_totalprice") / 1000, 2).alias("value"))))


@query(
    shown(
        S
        + """
--
SELECT s.series_id, s.date AS origin, s.pos, s.y, h AS horizon, t.date AS target, t.y AS y_true, ln(t.y) - ln(s.y) AS log_change
FROM s, (SELECT unnest([1, 3, 6, 12]) AS h) JOIN s t ON t.series_id = s.series_id AND t.pos = s.pos + h""",
        "y y_true log_change",
        "origin target",
    )
)
def targets_direct(spark, sf):
    s = series(spark, sf)
    return told(se.direct_targets(s, s, bt.HORIZONS))


@query(
    shown(
        R
        + f""", f AS (SELECT *, CASE WHEN {LAG.format(12)} IS NOT NULL AND {_full("stddev_samp", "r", 12)} IS NOT NULL THEN 1 ELSE 0 END AS ok FROM r)
--
SELECT a.series_id, a.date AS origin, h AS horizon, count_if(b.ok = 1) AS pairs
FROM f a, (SELECT unnest([1, 3, 6, 12]) AS h) JOIN f b ON b.series_id = a.series_id AND b.pos + h <= a.pos GROUP BY ALL""",
        "",
        "origin",
    )
)
def train_pair_counts(spark, sf):
    f = se.internal_features(series(spark, sf))
    return told(se.training_pairs(f, bt.HORIZONS, ["y12", "vol12"]))


@query(shown(E + "\n--\nSELECT * FROM e", "y_true y_pred", "origin target"))
def bt_errors(spark, sf):
    return told(errors(spark, sf))


@query(shown(E + "\n--" + METRICS.format("e"), MF))
def bt_leaderboard(spark, sf):
    return told(bt.metrics(errors(spark, sf)))


GAP = "e2 AS (SELECT * FROM e WHERE NOT (model = 'drift' AND extract(month FROM origin) = 7))"


def _gapped(spark, sf) -> DataFrame:
    """The errors without one model's in every July, so that origins differ."""
    return errors(spark, sf).filter("NOT (model = 'drift' AND month(origin) = 7)")


@query(
    shown(
        E
        + f""", {GAP}, a AS (SELECT series_id, horizon, count(DISTINCT model) AS all_models FROM e2 GROUP BY ALL),
c AS (SELECT * FROM (SELECT series_id, horizon, origin, count(DISTINCT model) AS n FROM e2 GROUP BY ALL) JOIN a USING (series_id, horizon) WHERE n = all_models),
k AS (SELECT e2.* FROM e2 SEMI JOIN c USING (series_id, horizon, origin))
--"""
        + METRICS.format("k"),
        MF,
    )
)
def bt_common_origin(spark, sf):
    return told(bt.metrics(bt.common_origins(_gapped(spark, sf))))


MEMBERS = ["naive", "drift", "mean_reversion"]


@query(
    shown(
        E
        + f""", {GAP}, g AS (
  SELECT series_id, horizon, origin, target, first(y_true) AS y_true, avg(y_pred) AS ensemble,
         {', '.join(f"avg(y_pred) FILTER (model <> '{m}') AS ensemble_without_{m}" for m in MEMBERS)}
  FROM e2 WHERE model IN ('naive', 'drift', 'mean_reversion') GROUP BY ALL HAVING count(DISTINCT model) = 3 AND count(*) = 3)
--
SELECT series_id, model, horizon, origin, target, y_true, y_pred FROM (
  UNPIVOT g ON ensemble, {', '.join(f'ensemble_without_{m}' for m in MEMBERS)} INTO NAME model VALUE y_pred)""",
        "y_true y_pred",
        "origin target",
    )
)
def bt_ensemble(spark, sf):
    return told(bt.ensembles(_gapped(spark, sf), MEMBERS))


COHORTS = [("early", "target", "1997-01-01", "1999-06-01"), ("late", "target", "1999-07-01", "2001-12-01"), ("all", "origin", "1995-01-01", "2001-12-01")]


@query(
    shown(
        S
        + f""", o AS (SELECT *, {', '.join(f"CASE WHEN pos >= {w - 1} THEN avg(ln(y)) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END AS l{w}" for w in (12, 24, 36))} FROM s),
j AS (SELECT o.series_id, horizon, o.date AS origin, t.date AS target, t.y AS y_true, o.y AS naive, {', '.join(f'exp(l{w} + (ln(o.y) - l{w}) * exp(horizon * (-ln(2) / {h}))) AS {n}' for n, (w, h) in GRID.items())}
  FROM o, (SELECT unnest([1, 6]) AS horizon) JOIN s t ON t.series_id = o.series_id AND t.pos = o.pos + horizon WHERE o.pos >= 11),
u AS (SELECT * FROM (UNPIVOT j ON naive, {', '.join(GRID)} INTO NAME model VALUE y_pred))
--
SELECT c.cohort, series_id, model, horizon, count(*) AS n, avg(abs(y_true - y_pred)) AS mae
FROM u JOIN (VALUES {', '.join(f"('{n}', '{x}', DATE '{a}', DATE '{b}')" for n, x, a, b in COHORTS)}) c(cohort, axis, a, b)
  ON (CASE WHEN axis = 'origin' THEN u.origin ELSE u.target END) BETWEEN c.a AND c.b GROUP BY ALL""",
        "mae",
    )
)
def mr_sensitivity(spark, sf):
    """Reversion with every window and half-life where its window is full, in cohorts of targets and of origins."""
    e = bt.backtest(series(spark, sf), [1, 6], 12, GRID, whole=True).filter("model NOT IN ('drift', 'historical_mean')")
    rows = bt.in_cohorts(e, COHORTS)
    return told(rows.groupBy("cohort", "series_id", "model", "horizon").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae")))


WIDTHS = """w AS (
  SELECT series_id, model, horizon, count(*) AS calibration_n,
         list_sort(list(abs(ln(y_true / y_pred))))[(ceil((count(*) - 1) * 0.9) + 1)::INT] AS half_width
  FROM e WHERE target <= DATE '1999-12-31' GROUP BY ALL HAVING count(*) >= 20)"""


@query(shown(E + f", {WIDTHS}\n--\nSELECT * FROM w", "half_width"))
def interval_widths(spark, sf):
    return told(bt.interval_widths(errors(spark, sf), "1999-12-31"))


@query(
    shown(
        E
        + f""", {WIDTHS}, t AS (
  SELECT e.*, calibration_n, y_pred * exp(-half_width) AS lo, y_pred * exp(half_width) AS hi
  FROM e JOIN w USING (series_id, model, horizon) WHERE origin >= DATE '{START}')
--
SELECT series_id, model, horizon, count(*) AS n, first(calibration_n) AS calibration_n, avg((y_true BETWEEN lo AND hi)::INT) AS coverage,
  avg(hi - lo) AS mean_width, avg(greatest(0.05 * (y_true - lo), -0.95 * (y_true - lo))) AS pinball_low,
  avg(greatest(0.95 * (y_true - hi), -0.05 * (y_true - hi))) AS pinball_high,
  avg(hi - lo + 20 * (greatest(lo - y_true, 0) + greatest(y_true - hi, 0))) AS interval_score
FROM t GROUP BY ALL""",
        "coverage mean_width pinball_low pinball_high interval_score",
    )
)
def interval_evaluation(spark, sf):
    return told(bt.interval_evaluation(errors(spark, sf), START))


@query(
    shown(
        E
        + """, d AS (SELECT DISTINCT series_id, origin FROM e),
i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY origin) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM d)
--
SELECT series_id, origin AS boundary FROM i WHERE i = least(n - 1, greatest(1, floor(n * 0.7)))""",
        "",
        "boundary",
    )
)
def calibration_boundary(spark, sf):
    return told(bt.calibration_cutoff(errors(spark, sf)))


@query(
    shown(
        R
        + """, c AS (SELECT series_id, date, (exp(r) - 1) * 100 AS change_pct, cume_dist() OVER (PARTITION BY series_id ORDER BY abs(r)) * 100 AS percentile,
  row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS l FROM r WHERE r IS NOT NULL)
--
SELECT series_id, date, change_pct, percentile FROM c WHERE l <= 6""",
        "change_pct percentile",
        "date",
    )
)
def log_change_percentile(spark, sf):
    return told(se.log_change_percentiles(series(spark, sf)))


DEV = E + ", d AS (SELECT * FROM e WHERE target < DATE '2000-01-01'), v AS (SELECT * FROM e WHERE origin >= DATE '2000-01-01')"


@query(
    shown(
        DEV
        + f""", a AS ({METRICS.format('d')}), b AS ({METRICS.format('v')}),
p AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY series_id, horizon ORDER BY mae, rmse, model) = 1)
--
SELECT p.series_id, p.horizon, p.model, p.mae AS development_mae, b.n, b.mae, b.rel_mae
FROM p JOIN b USING (series_id, horizon, model)""",
        "development_mae mae rel_mae",
    )
)
def select_argmin(spark, sf):
    e = errors(spark, sf)
    chosen = bt.selected(bt.metrics(e.filter("target < DATE '2000-01-01'")))
    test = bt.metrics(e.filter("origin >= DATE '2000-01-01'")).select("series_id", "horizon", "model", "n", "mae", "rel_mae")
    chosen = chosen.select("series_id", "horizon", "model", F.col("mae").alias("development_mae"))
    return told(chosen.join(test, ["series_id", "horizon", "model"]))


@query(
    shown(
        E
        + f""", a AS ({METRICS.format('e')})
--
SELECT series_id, model, horizon, rmse, row_number() OVER (PARTITION BY series_id, horizon ORDER BY rmse, model)::INT AS rank FROM a QUALIFY rank <= 3""",
        "rmse",
    )
)
def top3_per_horizon(spark, sf):
    return told(bt.best(bt.metrics(errors(spark, sf)), 3, "rmse").select("series_id", "model", "horizon", "rmse", "rank"))


@query(
    shown(
        E
        + f""", {GAP}, am AS (SELECT series_id, horizon, count(DISTINCT model) AS models, min(model) AS fm FROM e2 GROUP BY ALL),
o2 AS (SELECT series_id, horizon, origin, count(DISTINCT model) AS k, list(DISTINCT model) AS have FROM e2 GROUP BY ALL)
--
SELECT series_id, horizon, count_if(list_contains(have, fm)) AS n_origins, min(origin) FILTER (list_contains(have, fm)) AS first_origin,
  max(origin) FILTER (list_contains(have, fm)) AS last_origin, count_if(k = models) AS common, bool_and(k = models) AS all_same
FROM o2 JOIN am USING (series_id, horizon) GROUP BY ALL""",
        "",
        "first_origin last_origin",
    )
)
def fairness(spark, sf):
    return told(bt.fairness(_gapped(spark, sf)))


@query(
    shown(
        E
        + """, d AS (SELECT series_id, avg(a) AS scale FROM (SELECT series_id, pos, abs(y - lag(y) OVER (PARTITION BY series_id ORDER BY date)) AS a FROM s) WHERE pos < 24 GROUP BY 1)
--
SELECT series_id, model, horizon, avg(abs(y_true - y_pred)) / first(scale) AS mase,
  avg(abs(y_true - y_pred) * 200 / greatest(abs(y_true) + abs(y_pred), 1e-8)) AS smape,
  avg(abs(y_true - y_pred) * 400 / greatest(abs(y_true) + abs(y_pred), 1e-8)) AS smape_doubled
FROM e JOIN d USING (series_id) GROUP BY ALL""",
        "mase smape smape_doubled",
    )
)
def scaled_metrics(spark, sf):
    return told(bt.scaled_metrics(errors(spark, sf), bt.first_difference_scale(series(spark, sf), 24)))


@query(
    shown(
        S
        + """, a AS (SELECT series_id, corr(y, l) AS acf12 FROM (SELECT *, lag(y, 12) OVER (PARTITION BY series_id ORDER BY date) AS l FROM s) GROUP BY 1),
b AS (SELECT series_id, stddev_samp(v) / avg(v) AS spread FROM (SELECT series_id, extract(month FROM date) AS m, avg(y) AS v FROM s GROUP BY ALL) GROUP BY 1)
--
SELECT series_id, acf12, spread, acf12 > 0.2 AS by_acf, spread > 0.15 AS by_spread FROM a JOIN b USING (series_id)""",
        "acf12 spread",
    )
)
def seasonality(spark, sf):
    return told(se.seasonality(series(spark, sf)))


@query(
    shown(
        R
        + """, d AS (SELECT series_id, date, r - avg(r) OVER (PARTITION BY series_id) AS d FROM r WHERE r IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM d),
v AS (SELECT series_id, sum(d * d) AS v FROM d GROUP BY 1)
--
SELECT a.series_id, k::INT AS lag, sum(a.d * b.d) / first(v.v) AS acf
FROM n a, (SELECT unnest(range(1, 13)) AS k) JOIN n b ON b.series_id = a.series_id AND b.i = a.i - k JOIN v ON v.series_id = a.series_id GROUP BY ALL""",
        "acf",
    )
)
def return_autocorrelation(spark, sf):
    return told(se.autocorrelation(series(spark, sf), 12))


@query(
    shown(
        S
        + f""", l AS (SELECT *, ln(y) - ln({LAG.format(3)}) AS a, y - {LAG.format(3)} AS b FROM s), t AS (SELECT unnest([0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95])::DOUBLE AS tau),
g AS (SELECT series_id, arg_max(y, date) AS last, list_sort(list(a) FILTER (a IS NOT NULL)) AS la, list_sort(list(b) FILTER (b IS NOT NULL)) AS lb FROM l GROUP BY 1),
k AS (SELECT *, (len(la) - 1) * tau AS pl, floor((len(la) - 1) * tau)::INT + 1 AS i, ceil((len(la) - 1) * tau)::INT + 1 AS j FROM g, t)
--
SELECT series_id, tau, last * exp(la[i] + (pl - (i - 1)) * (la[j] - la[i])) AS by_return, last + lb[i] + (pl - (i - 1)) * (lb[j] - lb[i]) AS by_difference FROM k""",
        "tau by_return by_difference",
    )
)
def naive_quantiles(spark, sf):
    return told(bt.naive_quantiles(series(spark, sf), 3, LEVELS).select("series_id", "tau", "by_return", "by_difference"))


@query(
    shown(
        E
        + f""", {WIDTHS}, last AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) = 1),
f AS (SELECT series_id, horizon, (date + to_months(horizon))::DATE AS date, y AS naive, y + horizon * ((y - f) / pos) AS drift, mean_y AS historical_mean,
  exp(l36 + (ln(y) - l36) * exp(horizon * (-ln(2) / 12.0))) AS mean_reversion FROM last, (SELECT unnest([1, 3, 6, 12])::INT AS horizon)),
u AS (SELECT * FROM (UNPIVOT f ON naive, drift, historical_mean, mean_reversion INTO NAME model VALUE forecast))
--
SELECT u.series_id, u.model, u.horizon, u.date, u.forecast, forecast * exp(-half_width) AS low, forecast * exp(half_width) AS high
FROM u LEFT JOIN w ON w.series_id = u.series_id AND w.model = u.model AND w.horizon = u.horizon""",
        "forecast low high",
        "date",
    )
)
def final_forecast(spark, sf):
    return told(bt.forecast(series(spark, sf), bt.interval_widths(errors(spark, sf), "1999-12-31"), bt.HORIZONS))


@query(
    shown(
        E
        + """
--
SELECT series_id, origin, target, horizon, abs(a.y_true - a.y_pred) - abs(b.y_true - b.y_pred) AS difference
FROM (SELECT * FROM e WHERE model = 'mean_reversion') a JOIN (SELECT * FROM e WHERE model = 'naive') b USING (series_id, origin, target, horizon)""",
        "difference",
        "origin target",
    )
)
def paired_difference(spark, sf):
    return told(bt.paired(errors(spark, sf), "mean_reversion", "naive"))


@query(
    shown(
        S
        + """, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s),
c AS (SELECT *, floor(n * 0.7)::BIGINT AS a, floor(n * 0.85)::BIGINT AS b FROM n),
x AS (SELECT *, CASE WHEN pos < b - 1 THEN a ELSE b END AS st, CASE WHEN pos < b - 1 THEN b ELSE n END AS en FROM c)
--
SELECT series_id, date, pos, y, CASE WHEN pos < a THEN 'train' WHEN pos < b THEN 'validation' ELSE 'test' END AS part,
  pos >= st - 1 AND pos + 3 < en AND (pos - (st - 1)) % 3 = 0 AS is_origin FROM x""",
        "y",
        "date",
    )
)
def chronological_split(spark, sf):
    return told(se.splits(series(spark, sf), horizon=3))


@query(
    """WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
b AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view' AND value IS NOT NULL)
SELECT a.user_id, CAST(a.ts AS VARCHAR) AS ts, round((SELECT arg_max(value, b.ts) FROM b WHERE b.user_id = a.user_id AND b.ts <= a.ts), 6) AS value FROM a"""
)
def as_of_join(spark, sf):
    e = table(spark, sf, "events")
    out = se.as_of(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), "user_id", "ts", "value")
    return told(out.withColumn("ts", F.col("ts").cast("string")))


QS = S + """, q AS (SELECT series_id, pos, y, [""" + ", ".join(f"lag(y, {k}) OVER w" for k in range(1, 8)) + """] AS q
  FROM s WINDOW w AS (PARTITION BY series_id ORDER BY date)), k AS (SELECT *, list_sort(q) AS z FROM q WHERE pos >= 7),
t AS (SELECT [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]::DOUBLE[] AS t),
p AS (SELECT k.*, list_transform(range(1, 8), lambda i: greatest(t[i] * (y - z[i]), (t[i] - 1) * (y - z[i]))) AS p,
  list_transform(range(1, 8), lambda i: greatest(t[i] * (z[i] - y), (t[i] - 1) * (z[i] - y))) AS m, t FROM k, t),
c AS (SELECT *, list_sum(list_transform(range(2, 8), lambda i: (t[i] - t[i - 1]) * (p[i] + p[i - 1]) / 2)) AS area FROM p)"""


@query(
    shown(
        QS
        + """
--
SELECT count(*) AS n, avg(list_avg(p)) AS pinball, avg(list_avg(m)) AS pinball_mirrored, avg(area) AS crps, avg(area) * 2 AS crps_doubled,
  avg((y BETWEEN z[1] AND z[7])::INT) AS coverage, avg(z[7] - z[1]) AS width,
  avg(z[7] - z[1] + 2 / (1 - (0.95::DOUBLE - 0.05::DOUBLE)) * (greatest(z[1] - y, 0) + greatest(y - z[7], 0))) AS winkler,
  avg((len(list_filter(range(2, 8), lambda i: q[i] < q[i - 1])) > 0)::INT) AS crossing_rate FROM c""",
        "pinball pinball_mirrored crps crps_doubled coverage width winkler crossing_rate",
    )
)
def quantile_scores(spark, sf):
    """Quantile forecasts here are the seven values before each month."""
    past = F.array(*[F.lag("y", k).over(fr.ordered()) for k in range(1, 8)])
    return told(bt.quantile_scores(series(spark, sf).withColumn("q", past).filter("pos >= 7"), LEVELS))


@query(
    shown(
        S
        + f""", l AS (SELECT series_id, date, pos, y, ln(y) AS a, ln({LAG.format(1)}) AS b FROM s),
g AS (SELECT *, regr_slope(a, b) OVER w AS k, regr_intercept(a, b) OVER w AS c FROM l WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
--
SELECT series_id, date, k AS slope, c AS intercept, exp(c + k * a) AS forecast FROM g WHERE pos >= 23""",
        "slope intercept forecast",
        "date",
    )
)
def ar1_expanding(spark, sf):
    """One-step AR(1) of logs by least squares on all months so far, as windows."""
    from tidewater.operators.models import ar1

    return told(ar1(series(spark, sf), 24))


@query(
    shown(
        E
        + """, c AS (SELECT series_id, horizon, model, avg(abs(y_true - y_pred)) AS mae FROM e GROUP BY ALL)
--
SELECT series_id, horizon, max(mae) FILTER (model = 'naive') AS naive, max(mae) FILTER (model = 'mean_reversion') AS mean_reversion,
  max(mae) FILTER (model = 'mean_reversion') - max(mae) FILTER (model = 'naive') AS contribution FROM c GROUP BY ALL""",
        "naive mean_reversion contribution",
    )
)
def track_contribution(spark, sf):
    t = bt.metrics(errors(spark, sf)).groupBy("series_id", "horizon").pivot("model", ["naive", "mean_reversion"]).agg(F.first("mae"))
    return told(t.withColumn("contribution", F.col("mean_reversion") - F.col("naive")))


@query()
def fitted_forecasts(spark, sf):
    from tidewater.operators.models import fitted_forecasts

    return told(fitted_forecasts(series(spark, sf)))


@query()
def ridge_direct(spark, sf):
    from tidewater.operators.models import ridge_direct

    s = series(spark, sf)
    return told(ridge_direct(se.direct_targets(s, se.internal_features(s), bt.HORIZONS), ["y", "y1", "y12", "ma3", "ma12", "vol12"]))


@query(
    shown(
        E
        + """, d AS (SELECT a.series_id, a.horizon, a.origin, abs(a.y_true - a.y_pred) - abs(b.y_true - b.y_pred) AS difference
  FROM e a JOIN e b USING (series_id, horizon, origin) WHERE a.model = 'mean_reversion' AND b.model = 'naive'),
i AS (SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY origin) - 1 AS at, count(*) OVER (PARTITION BY series_id, horizon) AS n FROM d),
b AS (SELECT DISTINCT series_id, horizon, n, s, k, ('0x' || md5('blocks-1 ' || s || ' ' || k)[1:8])::BIGINT % n AS start, least(horizon, n - k * horizon) AS size
  FROM i, (SELECT unnest(range(2000)) AS s), LATERAL (SELECT unnest(range(ceil(n / horizon)::BIGINT)) AS k) WHERE n >= 4 * horizon),
p AS (SELECT series_id, horizon, n, s, (start + x) % n AS at FROM (SELECT *, unnest(range(size)) AS x FROM b)),
mm AS (SELECT p.series_id, p.horizon, s, sum(difference) / first(p.n) AS m FROM p JOIN i ON i.series_id = p.series_id AND i.horizon = p.horizon AND i.at = p.at GROUP BY ALL),
q AS (SELECT series_id, horizon, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM mm GROUP BY ALL),
g AS (SELECT series_id, horizon, count(*) AS n, avg(difference) AS mean FROM d GROUP BY ALL)
--
SELECT g.series_id, g.horizon, n, mean, low, high FROM g LEFT JOIN q ON q.series_id = g.series_id AND q.horizon = g.horizon""",
        "mean low high",
    )
)
def bootstrap_intervals(spark, sf):
    from tidewater.operators.models import bootstrap_intervals

    return told(bootstrap_intervals(bt.paired(errors(spark, sf), "mean_reversion", "naive")))


@query(
    shown(
        R
        + f""", f AS (SELECT *, {LAG.format(12)} IS NOT NULL AS a, {_full("stddev_samp", "r", 12)} IS NOT NULL AS b FROM r),
x AS (SELECT f.*, h AS horizon FROM f, (SELECT unnest([1, 6]) AS h) JOIN s t ON t.series_id = f.series_id AND t.pos = f.pos + h),
z AS (SELECT series_id, horizon, date AS origin, 'lags' AS name FROM x WHERE a UNION ALL SELECT series_id, horizon, date, 'volatility' FROM x WHERE b AND extract(month FROM date) <> 5),
o AS (SELECT series_id, horizon, origin, count(*) AS n FROM z GROUP BY ALL),
c AS (SELECT series_id, horizon, count_if(n = 2) AS common, min(origin) FILTER (n = 2) AS first_common, max(origin) FILTER (n = 2) AS last_common, bool_and(n = 2) AS all_same FROM o GROUP BY ALL)
--
SELECT z.series_id, z.horizon, name, count(*) AS origins, first(common) AS common, first(first_common) AS first_common, first(last_common) AS last_common, first(all_same) AS all_same
FROM z JOIN c ON c.series_id = z.series_id AND c.horizon = z.horizon GROUP BY z.series_id, z.horizon, name""",
        "",
        "first_common last_common",
    )
)
def origin_evidence(spark, sf):
    s = series(spark, sf)
    t = se.direct_targets(s, se.internal_features(s), [1, 6])
    a = t.filter("y12 IS NOT NULL").withColumn("name", F.lit("lags"))
    b = t.filter("vol12 IS NOT NULL AND month(origin) != 5").withColumn("name", F.lit("volatility"))
    keys = ["series_id", "name", "horizon", "origin"]
    return told(bt.origin_evidence(a.select(*keys).unionByName(b.select(*keys))))


@query(
    shown(
        S
        + """, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s),
e AS (SELECT *, min(pos) FILTER (i >= floor(n * 0.8)) OVER (PARTITION BY series_id) AS edge FROM n)
--
SELECT series_id, date, pos, y, CASE WHEN pos >= edge THEN 'validation' WHEN pos + 6 < edge THEN 'train' END AS part FROM e""",
        "y",
        "date",
    )
)
def purged_split(spark, sf):
    return told(se.inner_split(series(spark, sf), 6))


@query(
    shown(
        R
        + """, w AS (SELECT *, list(r) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS l,
  list(ln(y)) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS a FROM r)
--
SELECT series_id, date AS origin, pos, len(l)::INT AS n_x, len(a)::INT AS n_y, list_sum(l) AS sum_x, a[6] - ln(y) AS last_y
FROM w WHERE len(a) = 6 AND len(list_filter(l, lambda v: v IS NOT NULL)) = 12""",
        "sum_x last_y",
        "origin",
    )
)
def sequence_windows(spark, sf):
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    w = se.windows(series(spark, sf), 12, 6)
    return told(w.select("series_id", "origin", "pos", F.size("x").alias("n_x"), F.size("y").alias("n_y"), total.alias("sum_x"), F.element_at("y", 6).alias("last_y")))


@query(
    shown(
        R
        + """, q AS (SELECT series_id, date, r, r - avg(r) OVER (PARTITION BY series_id) AS d, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM r WHERE r IS NOT NULL),
v AS (SELECT series_id, count(*) AS n, sum(d * d) AS s2, sum(d ** 3) AS s3, sum(d ** 4) AS s4 FROM q GROUP BY 1),
c AS (SELECT a.series_id, k, sum(a.d * b.d) AS g FROM q a, (SELECT unnest(range(1, 13)) AS k) JOIN q b ON b.series_id = a.series_id AND b.i = a.i - k GROUP BY ALL),
l AS (SELECT c.series_id, sum(n * (n + 2) * (g / s2) ** 2 / (n - k)) AS ljung_box FROM c JOIN v ON v.series_id = c.series_id GROUP BY ALL),
j AS (SELECT series_id, n, n / 6 * (((s3 / n) / (s2 / n) ** 1.5) ** 2 + ((s4 / n) / (s2 / n) ** 2 - 3) ** 2 / 4) AS jb FROM v)
--
SELECT j.series_id, n, ljung_box, jb AS jarque_bera, exp(-jb / 2) AS jarque_bera_p FROM j JOIN l ON l.series_id = j.series_id""",
        "ljung_box jarque_bera jarque_bera_p",
    )
)
def return_tests(spark, sf):
    return told(se.return_tests(series(spark, sf)))


@query(
    shown(
        """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 6 THEN strftime(o_orderdate, '%Y.%m') WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN 3 THEN strftime(o_orderdate, '%m.%Y') ELSE 'n/a' END AS d FROM orders)
--
SELECT o_orderkey, coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%m.%Y'),
  try_strptime(d, '%Y-%m-%d %H:%M:%S'), try_strptime(d, '%Y.%m'))::DATE AS date FROM t""",
        "",
        "date",
    )
)
def mixed_dates(spark, sf):
    """Dates told in seven ways; a month above 12 shows that a date has the month first."""
    k, d = F.col("o_orderkey") % 7, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "MM/dd/yyyy"))
    text = text.when(k == 3, F.date_format(d, "MM.yyyy")).when(k == 5, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 6, F.date_format(d, "yyyy.MM")).otherwise("n/a")
    return told(table(spark, sf, "orders").select("o_orderkey", se.parsed_date(text).alias("date")))


@query()
def pooled_models(spark, sf):
    from tidewater.operators.tracks import evaluate_track

    s = series(spark, sf)
    records = se.direct_targets(s, se.lagged_features(s), [1, 6])
    return told(evaluate_track(records, ["y", "lag_1", "lag_12", "rolling_mean_3", "rolling_mean_12", "rolling_std_12", "momentum_6"]))


@query()
def stationarity(spark, sf):
    from tidewater.operators.arima import stationarity

    return told(stationarity(series(spark, sf)))


@query()
def arima_search(spark, sf):
    from tidewater.operators.arima import search

    return told(search(series(spark, sf)))


@query()
def arima_selected(spark, sf):
    """The chosen ARMA of differences and ARIMA at every twelfth origin, in the form of the other errors."""
    from tidewater.operators import arima

    return told(arima.expanding(series(spark, sf), {"selected_arma": arima.selected_arma, "selected_arima": arima.selected_arima}, bt.HORIZONS, 36, 12))


@query()
def classic_backtest(spark, sf):
    """AR, ARMA and ARIMA of fixed orders, scored like the closed forms, at every sixth origin."""
    from tidewater.operators import arima

    return told(bt.metrics(arima.expanding(series(spark, sf), arima.classic_models(), bt.HORIZONS, 36, 6)))


@query()
def boosted_direct(spark, sf):
    from tidewater.operators.learners import boosted_direct

    s = series(spark, sf)
    return told(boosted_direct(se.direct_targets(s, se.internal_features(s), [1, 6]), ["y", "y1", "y12", "ma3", "ma12", "vol12"], least_pairs=24))


@query()
def boosted_quantiles(spark, sf):
    from tidewater.operators.learners import LEVELS as levels
    from tidewater.operators.learners import boosted_direct

    s = series(spark, sf)
    return told(boosted_direct(se.direct_targets(s, se.internal_features(s), [1, 6]), ["y", "y1", "y12", "ma3", "ma12", "vol12"], levels, least_pairs=24))


@query()
def network_forecasts(spark, sf):
    from tidewater.operators.learners import network_forecasts

    s = series(spark, sf)
    w = se.windows(s, 12, 6).join(s.select("series_id", "pos", F.col("y").alias("last")), ["series_id", "pos"])
    return told(network_forecasts(w, LEVELS))


@query(
    """SELECT o_orderkey, CAST((date_trunc('month', o_orderdate) - INTERVAL 1 MONTH)::DATE AS VARCHAR) AS start, CAST((date_trunc('month', o_orderdate) - INTERVAL 1 DAY)::DATE AS VARCHAR) AS "end",
  date_diff('month', DATE '1992-03-15', o_orderdate::DATE)::INT AS months, extract(day FROM last_day(o_orderdate::DATE))::INT AS days,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(last_day(o_orderdate::DATE) AS VARCHAR) END AS named, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate::DATE AS VARCHAR) END AS stamped FROM orders"""
)
def calendar_dates(spark, sf):
    """The month before, months since a day, days of the month; months named as YYYY-MM or not, and stamps of two offsets."""
    o, d, k = table(spark, sf, "orders"), F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    name = F.when(k % 2 == 0, F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyy-M-d"))
    stamp = F.concat(F.date_format(d, "yyyy-MM-dd"), F.when(k % 3 > 0, "T01:00:00+03:00").otherwise("T01:00:00+00:00"))
    before = se.previous_month(d)
    return o.select(
        "o_orderkey", before["start"].cast("string").alias("start"), before["end"].cast("string").alias("end"), se.month_difference(d, F.lit("1992-03-15").cast("date")).alias("months"),
        se.days_in_month(d).alias("days"), se.named_month(name)["end"].cast("string").alias("named"), se.stamped_day(stamp).cast("string").alias("stamped"),
    )


@query(
    shown(
        E
        + """, p AS (SELECT *, CASE WHEN extract(year FROM origin) < 1998 THEN 'validation' ELSE 'test' END AS period FROM e),
d AS (SELECT *, abs(y_true - lag(y_true) OVER (PARTITION BY series_id, period, model, horizon ORDER BY origin)) AS step FROM p),
x AS (SELECT series_id, period, model, horizon, count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) ** 2)) AS rmse,
  avg(abs(y_pred - y_true)) / CASE WHEN count(*) > 1 THEN greatest(avg(step), 1e-12) ELSE 1 END AS mase, avg(200 * abs(y_pred - y_true) / (abs(y_true) + abs(y_pred) + 1e-12)) AS smape FROM d GROUP BY ALL)
--
SELECT x.*, x.mae / b.mae AS rel_mae FROM x JOIN x b ON b.series_id = x.series_id AND b.period = x.period AND b.horizon = x.horizon AND b.model = 'naive'""",
        "mae rmse mase smape rel_mae",
    )
)
def extended_summary(spark, sf):
    period = F.when(F.year("origin") < 1998, "validation").otherwise("test")
    return told(bt.extended_summary(errors(spark, sf).withColumn("period", period)))


@query(
    shown(
        E
        + """, q AS (SELECT *, unnest(range(1, 20)) * 0.05::DOUBLE AS tau FROM e WHERE model = 'mean_reversion'),
v AS (SELECT series_id, horizon, origin, y_true, round(tau, 2) AS tau, y_pred * (0.8 + 0.4 * round(tau, 2)) AS x FROM q),
l AS (SELECT *, greatest((y_true - x) * tau, (y_true - x) * (tau - 1)) AS loss FROM v),
t AS (SELECT *, (loss + lag(loss) OVER (PARTITION BY series_id, horizon, origin ORDER BY tau)) / 2 * 0.05 AS area FROM l),
r AS (SELECT series_id, horizon, origin, first(y_true) AS y, avg(loss) AS loss, 2 * sum(area) AS crps, min(x) AS lo, max(x) AS hi FROM t GROUP BY ALL)
--
SELECT series_id, horizon, count(*) AS n, avg(loss) AS pinball, avg(crps) AS crps_central, avg((y >= lo AND y <= hi)::INT) AS coverage90, avg(hi - lo) AS width90,
  avg(hi - lo + 20 * greatest(lo - y, 0) + 20 * greatest(y - hi, 0)) AS interval_score90 FROM r GROUP BY ALL""",
        "pinball crps_central coverage90 width90 interval_score90",
    )
)
def quantile_grid_scores(spark, sf):
    """Nineteen levels, from 80 to 120 percent of a point forecast."""
    levels = bt.LEVELS_19
    rows = errors(spark, sf).filter("model = 'mean_reversion'").withColumn("q", F.array(*[F.col("y_pred") * (0.8 + 0.4 * t) for t in levels]))
    return told(bt.quantile_grid_metrics(rows, ["series_id", "horizon"], levels))


@query(
    shown(
        S
        + """, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS b, count(*) OVER (PARTITION BY series_id) AS n FROM s)
--
SELECT series_id, date, pos, y, b <= greatest(6, least(24, n // 5)) AS is_test FROM n""",
        "y",
        "date",
    )
)
def tail_split(spark, sf):
    return told(se.last_rows(series(spark, sf)))


@query(
    shown(
        R
        + """, q AS (SELECT series_id, r, r - avg(r) OVER (PARTITION BY series_id) AS d, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM r WHERE r IS NOT NULL),
v AS (SELECT series_id, sum(d * d) AS s2 FROM q GROUP BY 1),
c AS (SELECT a.series_id, k, sum(a.d * b.d) / first(s2) AS r FROM q a JOIN v ON v.series_id = a.series_id, (SELECT unnest([1, 2]) AS k) JOIN q b ON b.series_id = a.series_id AND b.i = a.i - k GROUP BY ALL),
w AS (SELECT series_id, max(r) FILTER (k = 1) AS r1, max(r) FILTER (k = 2) AS r2 FROM c GROUP BY 1)
--
SELECT series_id, 1::INT AS lag, r1 AS acf, r1 AS pacf FROM w UNION ALL SELECT series_id, 2, r2, (r2 - r1 * r1) / (1 - r1 * r1) FROM w""",
        "acf pacf",
    )
)
def partial_autocorrelation(spark, sf):
    """The first two lags, which have closed forms."""
    from tidewater.operators.arima import return_lags

    return told(return_lags(series(spark, sf)).filter("lag <= 2"))


@query()
def quantile_autoregressions(spark, sf):
    from tidewater.operators.models import quantile_autoregression

    return told(quantile_autoregression(series(spark, sf), 3, LEVELS))


@query(
    shown(
        E
        + f""", b AS ({METRICS.format("e")}),
sc AS (SELECT series_id, avg(d) AS scale FROM (SELECT series_id, pos, abs(y - lag(y) OVER (PARTITION BY series_id ORDER BY pos)) AS d FROM s) WHERE pos < 24 GROUP BY 1),
x AS (SELECT e.series_id, model, horizon, avg(abs(y_true - y_pred)) / first(scale) AS mase, avg(abs(y_true - y_pred) * 200 / greatest(abs(y_true) + abs(y_pred), 1e-8)) AS smape,
  avg(abs(y_true - y_pred) * 400 / greatest(abs(y_true) + abs(y_pred), 1e-8)) AS smape_doubled FROM e JOIN sc ON sc.series_id = e.series_id GROUP BY ALL)
--
SELECT b.*, mase, smape, smape_doubled, CASE WHEN b.model = 'naive' THEN 'baseline' ELSE 'classical' END AS family,
  row_number() OVER (PARTITION BY b.series_id, b.horizon ORDER BY mae, rmse, b.model)::INT AS place FROM b JOIN x ON x.series_id = b.series_id AND x.model = b.model AND x.horizon = b.horizon""",
        MF + " mase smape smape_doubled",
    )
)
def final_leaderboard(spark, sf):
    s = series(spark, sf)
    return told(bt.leaderboard(errors(spark, sf), bt.first_difference_scale(s, 24), {"naive": "baseline"}))


@query(
    shown(
        E
        + """, d AS (SELECT DISTINCT series_id, origin FROM e),
i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY origin) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM d),
b AS (SELECT series_id, origin AS boundary FROM i WHERE i = least(n - 1, greatest(1, floor(n * 0.7))))
--
SELECT e.series_id, model, horizon, count(*) AS calibration_n, list_sort(list(abs(ln(y_true / y_pred))))[(ceil((count(*) - 1) * 0.9) + 1)::INT] AS half_width
FROM e JOIN b ON b.series_id = e.series_id WHERE target <= boundary GROUP BY e.series_id, model, horizon""",
        "half_width",
    )
)
def calibrated_widths(spark, sf):
    return told(bt.calibrated(errors(spark, sf)))
