"""Pooled direct models: one regression for all series and horizons of a feature set, chosen on validation, scored on test."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.frames import SERIES
from tidewater.functions.scores import smape

SEED = 42


def origin_parts(records: DataFrame, first: float = 0.70, second: float = 0.85, purge: bool = False) -> DataFrame:
    """records with part by the place of their origin among the distinct origins; with purge, training rows whose
    target lies after the last training origin have none."""
    dates = records.select("origin").distinct()
    n = dates.count()
    rank = F.row_number().over(W.orderBy("origin"))  # months: a few hundred rows at most
    place = dates.withColumn("part", F.when(rank <= int(n * first), "train").when(rank <= int(n * second), "validation").otherwise("test"))
    rows = records.join(F.broadcast(place), "origin")
    if purge:
        last = place.filter("part = 'train'").agg(F.max("origin")).first()[0]
        rows = rows.withColumn("part", F.when((F.col("part") != "train") | (F.col("target") <= F.lit(last)), F.col("part")))
    return rows


def candidates() -> dict[str, list]:
    """Models by name, each with its settings in order of preference on a tie."""
    linear = lambda a, e: LinearRegression(labelCol="y_true", regParam=a, elasticNetParam=e, predictionCol="y_pred")
    return {
        "ridge": [linear(a, 0.0) for a in (0.1, 1.0, 10.0)],
        "elastic_net": [linear(a, 0.5) for a in (0.1, 1.0)],
        "random_forest": [RandomForestRegressor(labelCol="y_true", predictionCol="y_pred", numTrees=40, maxDepth=d, seed=SEED) for d in (3, 6)],
        "boosted_trees": [GBTRegressor(labelCol="y_true", predictionCol="y_pred", maxIter=20, maxDepth=3, stepSize=0.1, seed=SEED)],
    }


def evaluate_track(records: DataFrame, columns: list[str], models: dict[str, list] | None = None, scale: DataFrame | None = None) -> DataFrame:
    """model, horizon, n, mae, rmse, smape on the test part; and mase with a scale (series_id, scale) of each series.

    Missing features get the training median. Each model's settings are compared by validation MAE, and the
    best is fitted again on training and validation rows.
    """
    parts = origin_parts(records.filter("y_true IS NOT NULL"))
    filled = [f"_f_{c}" for c in columns]
    out = None
    for name, settings in (models or candidates()).items():
        plans = [Pipeline(stages=[Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), s]) for s in settings]
        train, check = parts.filter("part = 'train'"), parts.filter("part = 'validation'")
        losses = [p.fit(train).transform(check).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred")))).first()[0] for p in plans] if len(plans) > 1 else [0.0]
        best = plans[losses.index(min(losses))].fit(parts.filter("part != 'test'"))
        made = best.transform(parts.filter("part = 'test'")).select(SERIES, F.lit(name).alias("model"), "horizon", "y_true", "y_pred")
        out = made if out is None else out.unionByName(made)
    e = F.col("y_true") - F.col("y_pred")
    more = [] if scale is None else [F.avg(F.abs(e) / F.col("scale")).alias("mase")]
    out = out if scale is None else out.join(F.broadcast(scale), SERIES)
    return out.groupBy("model", "horizon").agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(smape(F.col("y_true"), F.col("y_pred"))).alias("smape"), *more
    )
