"""Aggregates and scores whose definitions differ from SQL's own, each under its own name."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_sum(value: Column) -> Column:
    """Sum that is null if any value is null, and 0 of no rows."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.coalesce(F.sum(value), F.lit(0.0)))


def strict_mean(value: Column, weight: Column) -> Column:
    """Weighted mean that is null if any value or weight is null, or if the weights sum to 0. Otherwise a value or weight that is not
    finite, or a weight below 0, is an error."""
    whole = F.count(F.when(value.isNotNull() & weight.isNotNull(), 1)) == F.count(F.lit(1))
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    bad = F.count_if(odd(value) | odd(weight) | (weight < 0)) > 0
    mean = F.try_divide(F.sum(value * weight), F.nullif(F.sum(weight), F.lit(0.0)))
    return F.when(whole, F.when(bad, F.raise_error(F.lit("a weight is below 0, or a number is not finite")).cast("double")).otherwise(mean))


def known_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over the rows that have both."""
    both = value.isNotNull() & weight.isNotNull()
    total = F.sum(F.when(both, weight))
    return F.try_divide(F.sum(F.when(both, value * weight)), F.nullif(total, F.lit(0.0)))


def quantile_higher(values: Column, level: float) -> Column:
    """The value at rank ceil((n - 1) * level) of a sorted array, from 0."""
    return F.element_at(values, (F.ceil((F.size(values) - 1) * F.lit(level)) + 1).cast("int"))


def pinball(actual: Column, forecast: Column, level: Column) -> Column:
    """Quantile loss: an actual above its forecast costs level, one below costs 1 - level."""
    error = actual - forecast
    return F.greatest(level * error, (level - 1) * error)


def pinball_mirrored(actual: Column, forecast: Column, level: Column) -> Column:
    """The same loss with the sides exchanged: an actual above its forecast costs 1 - level."""
    return pinball(forecast, actual, level)


def interval_score(actual: Column, low: Column, high: Column, alpha: float) -> Column:
    below, above = F.greatest(low - actual, F.lit(0.0)), F.greatest(actual - high, F.lit(0.0))
    return (high - low) + (below + above) * (2 / alpha)


def smape(actual: Column, forecast: Column, top: int = 200) -> Column:
    """Symmetric percentage error on 0..200, or doubled on 0..400."""
    return F.abs(actual - forecast) * top / F.greatest(F.abs(actual) + F.abs(forecast), F.lit(1e-8))


def trapezoid(values: Column, step: float) -> Column:
    """Integral of evenly spaced values."""
    n = F.size(values)
    inner = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return (inner - (F.element_at(values, 1) + F.element_at(values, n)) / 2) * step


def reversion(level: Column, mean: Column, horizon: Column, half_life: float) -> Column:
    """exp of a log level that goes half the way to its mean in half_life steps."""
    return F.exp(mean + (level - mean) * F.exp(horizon * F.lit(-math.log(2) / half_life)))
