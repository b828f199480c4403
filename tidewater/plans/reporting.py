"""Queries over the hourly grid of events, an event type for a system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import grid as gr
from tidewater.plans.catalog import query, shown, told
from tidewater.session import table

SYSTEMS = ["click", "purchase", "signup", "view", "error"]


def volumes(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    keys = [F.col("ts").cast("date").alias("date"), F.hour("ts").alias("hour"), F.col("event_type").alias("system")]
    return e.groupBy(*keys).agg(
        F.lit("actual").alias("status"), F.round(F.sum("value"), 2).alias("generation"), F.count("*").cast("double").alias("consumption")
    )


def prices(spark, sf) -> DataFrame:
    """A price for hours with two events or more; the largest value, null above 60."""
    e = table(spark, sf, "events")
    keys = [F.col("ts").cast("date").alias("date"), F.hour("ts").alias("hour"), F.col("event_type").alias("system")]
    mean = F.max("value")
    return e.groupBy(*keys).agg(F.count("*").alias("n"), F.when(mean <= 60, mean).alias("price")).filter("n >= 2").drop("n")


def keys(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    a, b = e.agg(F.min(F.col("ts").cast("date")), F.max(F.col("ts").cast("date"))).first()
    return gr.expected(a, b, e.select(F.col("event_type").alias("system")))


def rows(spark, sf) -> DataFrame:
    return gr.joined_prices(volumes(spark, sf), prices(spark, sf))


G = """
WITH v AS (SELECT ts::DATE AS date, extract(hour FROM ts)::INT AS hour, event_type AS system, 'actual' AS status, round(sum(value), 2) AS generation,
  count(*)::DOUBLE AS consumption, CASE WHEN count(*) >= 2 THEN 1 END AS has, CASE WHEN max(value) <= 60 THEN max(value) END AS pr FROM events GROUP BY ALL),
r AS (SELECT date, hour, system, status, generation, consumption, CASE WHEN has = 1 THEN pr END AS price,
  CASE WHEN has = 1 AND pr IS NOT NULL THEN NULL WHEN has = 1 THEN 'price is null' ELSE 'no price row' END AS price_reason FROM v),
k AS (SELECT d::DATE AS date, h::INT AS hour, system FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS d FROM events),
  (SELECT unnest(range(24)) AS h), (SELECT DISTINCT event_type AS system FROM events)),
c AS (SELECT k.date, k.hour, k.system, coalesce(status, 'missing') AS status, generation, consumption, price, price_reason FROM k LEFT JOIN r USING (date, hour, system))"""


@query(shown(G + "\n--\nSELECT * FROM c", "generation consumption price", "date"))
def grid_completed(spark, sf):
    return told(gr.completed(keys(spark, sf), rows(spark, sf)))


@query(
    shown(
        G
        + """, t AS (SELECT * FROM c UNION ALL SELECT date, hour, system, 'plan', -1.0, 1.0, NULL, ' ' FROM r WHERE hour = 3)
--
SELECT DISTINCT date, hour, system, rule FROM (
  SELECT *, unnest(list_filter([CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN status <> 'actual' THEN 'not_actual' END,
    CASE WHEN generation < 0 OR consumption < 0 THEN 'negative' END, CASE WHEN price IS NULL AND trim(coalesce(price_reason, '')) = '' THEN 'no_reason' END],
    lambda x: x IS NOT NULL)) AS rule FROM (SELECT *, count(*) OVER (PARTITION BY date, hour, system) AS n FROM t))""",
        "",
        "date",
    )
)
def grid_violations(spark, sf):
    r = rows(spark, sf)
    wrong = r.filter("hour = 3").select(
        *gr.KEYS, F.lit("plan").alias("status"), F.lit(-1.0).alias("generation"), F.lit(1.0).alias("consumption"),
        F.lit(None).cast("double").alias("price"), F.lit(" ").alias("price_reason"),
    )
    k = keys(spark, sf)
    return told(gr.violations(k, gr.completed(k, r).unionByName(wrong)))


TOTALS = """
SELECT date, hour, system, grouping(date, hour, system)::INT AS level, count(*) AS n,
  CASE WHEN count(generation) = count(*) THEN coalesce(sum(generation), 0) END AS generation,
  CASE WHEN count(consumption) = count(*) THEN coalesce(sum(consumption), 0) END AS consumption,
  CASE WHEN count(price + consumption) = count(*) THEN sum(price * consumption) / nullif(sum(consumption), 0) END AS price,
  sum(price * consumption) / nullif(sum(consumption) FILTER (price IS NOT NULL), 0) AS known_price, avg(price) AS mean_price, count(price) AS prices,
  sum(consumption) FILTER (price IS NOT NULL AND consumption IS NOT NULL) / nullif(CASE WHEN count(consumption) = count(*) THEN sum(consumption) END, 0) AS weight_share
FROM {0} GROUP BY GROUPING SETS ((date, hour), (system), ())"""
TF = "generation consumption price known_price mean_price weight_share"


@query(shown(G + "\n--" + TOTALS.format("r"), TF, "date"))
def grid_totals(spark, sf):
    return told(gr.totals(rows(spark, sf)))


@query(shown(G + "\n--" + TOTALS.format("c"), TF, "date"))
def grid_totals_completed(spark, sf):
    return told(gr.totals(gr.completed(keys(spark, sf), rows(spark, sf))))


@query(
    shown(
        G
        + f"""
--
SELECT date, hour, {', '.join(f"first(generation) FILTER (system = '{s}') AS {s}" for s in SYSTEMS)},
  {' + '.join(f"first(generation) FILTER (system = '{s}')" for s in SYSTEMS)} AS total FROM c GROUP BY date, hour""",
        " ".join([*SYSTEMS, "total"]),
        "date",
    )
)
def grid_wide(spark, sf):
    return told(gr.wide(gr.completed(keys(spark, sf), rows(spark, sf)), SYSTEMS, "generation"))


@query(
    G
    + """
SELECT count(*) AS expected, count_if(status = 'missing') AS missing, count_if(status = 'actual') AS actual, count_if(generation IS NULL) AS null_generation,
  count_if(consumption IS NULL) AS null_consumption, count_if(status = 'actual' AND price IS NULL) AS unpublished_prices, count_if(status = 'missing') = 0 AS complete FROM c"""
)
def grid_quality(spark, sf):
    k = keys(spark, sf)
    return gr.quality(gr.completed(k, rows(spark, sf)), k)
