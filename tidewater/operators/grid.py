"""Hourly grids: expected keys, violations, strict and partial totals, wide tables, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scores import known_mean, strict_mean, strict_sum

KEYS = ["date", "hour", "system"]


def expected(start, end, systems: DataFrame) -> DataFrame:
    """Every day from start to end, every hour from 0 to 23, every system; days and systems are few. ValueError if the end is before the
    start (ISO dates)."""
    if str(end) < str(start):
        raise ValueError("the period ends before it starts")
    days = systems.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    hours = days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return hours.crossJoin(F.broadcast(systems.select("system").distinct()))


def completed(grid: DataFrame, rows: DataFrame) -> DataFrame:
    """rows, and a row with status missing and no values for every key of the grid that rows lack."""
    lacking = grid.join(rows.select(*KEYS), KEYS, "left_anti").withColumn("status", F.lit("missing"))
    return rows.unionByName(lacking, allowMissingColumns=True)


def violations(grid: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that break a rule, with each rule: not_expected, repeated, not_actual, negative (or not finite) volume,
    no_reason (a null value whose reason is blank)."""
    known = grid.select(*KEYS, F.lit(True).alias("_known"))
    counts = rows.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    seen = rows.join(known, KEYS, "left").join(counts, KEYS, "left")
    bad = lambda c: F.col(c).isNotNull() & ((F.col(c) < 0) | F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
    blank = F.col("price").isNull() & (F.trim(F.coalesce(F.col("price_reason"), F.lit(""))) == "")
    rules = {
        "not_expected": F.col("_known").isNull(),
        "repeated": F.col("_n") > 1,
        "not_actual": F.col("status") != "actual",
        "negative": bad("generation") | bad("consumption"),
        "no_reason": blank,
    }
    told = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return seen.select(*KEYS, F.explode(told).alias("rule")).distinct()


def joined_prices(volumes: DataFrame, prices: DataFrame) -> DataFrame:
    """Volumes with their prices; the reason tells a price that is null from one that has no row. Prices without
    volumes are left out."""
    marked = prices.withColumn("_row", F.lit(True))
    reason = F.when(F.col("price").isNotNull(), None).when(F.col("_row"), "price is null").otherwise("no price row")
    return volumes.join(marked, KEYS, "left").withColumn("price_reason", reason).drop("_row")


def totals(rows: DataFrame) -> DataFrame:
    """Totals by (date, hour), by system and over all, in one pass of grouping sets. Volumes and the weighted price are
    null if any part is; the partial price counts the rows that have one."""
    p, w = F.col("price"), F.col("consumption")
    both = p.isNotNull() & w.isNotNull()
    sets = [[F.col("date"), F.col("hour")], [F.col("system")], []]
    return rows.groupingSets(sets, F.col("date"), F.col("hour"), F.col("system")).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("n"),
        strict_sum(F.col("generation")).alias("generation"),
        strict_sum(w).alias("consumption"),
        strict_mean(p, w).alias("price"),
        known_mean(p, w).alias("known_price"),
        F.avg(p).alias("mean_price"),
        F.count(p).alias("prices"),
        F.try_divide(F.sum(F.when(both, w)), F.nullif(strict_sum(w), F.lit(0.0))).alias("weight_share"),
    )


def wide(rows: DataFrame, systems: list[str], value: str) -> DataFrame:
    """A column for each system, and their strict total."""
    out = rows.groupBy("date", "hour").pivot("system", systems).agg(F.first(value))
    total = F.lit(0.0)
    for s in systems:
        total = total + F.col(f"`{s}`")
    return out.withColumn("total", total)


def quality(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """One row: keys expected and missing, whether all are there, nulls of each value, and unpublished prices."""
    lacking = grid.join(rows.filter("status != 'missing'").select(*KEYS), KEYS, "left_anti").agg(F.count("*").alias("missing"))
    counts = rows.agg(
        F.count_if(F.col("status") == "actual").alias("actual"),
        F.count_if(F.col("generation").isNull()).alias("null_generation"),
        F.count_if(F.col("consumption").isNull()).alias("null_consumption"),
        F.count_if((F.col("status") == "actual") & F.col("price").isNull()).alias("unpublished_prices"),
    )
    wanted = grid.agg(F.count("*").alias("expected"))
    return wanted.crossJoin(lacking).crossJoin(counts).withColumn("complete", F.col("missing") == 0)


def require_complete(report: DataFrame, allow_partial: bool = False) -> DataFrame:
    """The report of quality(), or ValueError if keys or values are lacking and a partial report is not allowed."""
    seen = report.first()
    lacking = {c: seen[c] for c in ("missing", "null_generation", "null_consumption", "unpublished_prices") if seen[c]}
    if lacking and not allow_partial:
        raise ValueError(", ".join(f"{n} {c}" for c, n in lacking.items()))
    return report


def lacking_keys(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """kind and key of what quality() counts: missing keys and rows without generation, consumption or a price."""
    there = rows.filter("status != 'missing'")
    parts = [grid.join(there.select(*KEYS), KEYS, "left_anti").withColumn("kind", F.lit("missing"))]
    parts += [there.filter(F.col(c).isNull()).withColumn("kind", F.lit(f"null_{c}")) for c in ("generation", "consumption", "price")]
    out = parts[0].select("kind", *KEYS)
    for p in parts[1:]:
        out = out.unionByName(p.select("kind", *KEYS))
    return out


def source_grid(volumes: DataFrame, prices: DataFrame, systems: DataFrame, start: str, end: str, offset: str = "+03:00") -> DataFrame:
    """date, hour, system, generation, consumption, price, price_reason of decoded answers: volumes (id, stamp, hour, generation, consumption), prices (date, id, hour, price)
    and systems (id, system).

    ValueError for an unknown id, a stamp with another offset or beyond the period, an hour beyond 0 to 23, or a repeated key.
    Prices without volumes are left out.
    """
    from tidewater.operators.series import stamped_day

    def known(rows: DataFrame, what: str) -> DataFrame:
        named = rows.join(F.broadcast(systems), "id", "left")
        bad = named.agg(
            F.count_if(F.col("system").isNull()).alias("ids"),
            F.count_if(F.coalesce(~F.col("date").between(start, end), F.lit(True))).alias("dates"),
            F.count_if(F.coalesce(~F.col("hour").between(0, 23), F.lit(True))).alias("hours"),
        ).first()
        repeated = named.groupBy(*KEYS).agg(F.count("*").alias("n")).filter("n > 1")
        if any(bad) or not repeated.isEmpty():
            raise ValueError(f"{what}: {bad['ids']} unknown ids, {bad['dates']} dates, {bad['hours']} hours, or repeated keys")
        return named.drop("id")

    v = known(volumes.withColumn("date", stamped_day(F.col("stamp"), offset)).drop("stamp"), "volumes")
    return joined_prices(v, known(prices.withColumn("date", F.col("date").cast("date")), "prices"))


def synthetic(spark, start: str, days: int, systems: list[str]) -> DataFrame:
    """A grid of plain numbers for demonstrations: generation 10, consumption the system's number, price a hundred times that."""
    names = F.array(*map(F.lit, systems))
    keys = spark.range(days * 24 * len(systems))
    i, hour = (F.col("id") % len(systems)).cast("int"), (F.floor(F.col("id") / len(systems)) % 24).cast("int")
    day = F.date_add(F.lit(start).cast("date"), F.floor(F.col("id") / (24 * len(systems))).cast("int"))
    return keys.select(
        day.alias("date"), hour.alias("hour"), F.get(names, i).alias("system"), F.lit("actual").alias("status"),
        F.lit(10.0).alias("generation"), (i + 1).cast("double").alias("consumption"), ((i + 1) * 100).cast("double").alias("price"), F.lit(None).cast("string").alias("price_reason"),
    )


def displayed(rows: DataFrame, names: dict[str, str], values: dict[str, dict[str, str]] | None = None, most: int | None = None) -> DataFrame:
    """rows under the names of a report, with the named values of columns replaced, flags as words, and the first `most` of them."""
    out = rows
    for column, words in (values or {}).items():
        out = out.withColumn(column, F.coalesce(F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[F.col(column).cast("string")], F.col(column).cast("string")))
    out = out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns])
    return out if most is None else out.limit(most)
