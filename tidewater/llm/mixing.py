"""Mixing sources to target weights: hash-random order, distributed prefix sums and exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import SPACES, WORD, written

#: Rows of a key range, about; ranges of a source are 16 to the power of the digits of the key that name them.
RANGE_ROWS = 50_000
LEAST_DIGITS, MOST_DIGITS = 3, 6
MOST_EPOCHS = 3


def words_in(text: Column) -> Column:
    """Words of text, 0 of null: the runs of spaces in it, when it has one at both ends, less one. Runs are counted on bytes, as a
    regexp holds a list of all words of a text. Every space becomes the pair of tab and newline, and the insides of runs go."""
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    runs = F.replace(F.replace(text, F.lit(" "), F.lit("\t\n")), F.lit("\n\t"), F.lit(""))
    count = F.octet_length(runs) - F.octet_length(F.replace(runs, F.lit("\t"), F.lit(""))) - 1
    return F.coalesce(count.cast("long"), F.lit(0).cast("long"))


def running(rows: DataFrame, order: list[Column], sums: list[str], what: str) -> DataFrame:
    """rows with before_<name>: the sum of each named column over all rows that come earlier. Rows are sorted into ranges,
    whose sums give each range its offset (a row for each range), and a running sum goes through each range."""
    placed = written(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), what)
    so_far = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("_p").agg(*[F.sum(c).alias(c) for c in sums]).select("_p", *[F.sum(c).over(so_far).alias(f"_{c}") for c in sums])
    inside = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = placed.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), zero) for c in sums}).join(F.broadcast(offsets), "_p")
    return placed.withColumns({f"before_{c}": F.col(f"before_{c}") + F.coalesce(f"_{c}", zero) for c in sums}).drop("_p", *[f"_{c}" for c in sums])


def targets(sizes: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes (key, source, source_size): with weight, target and the words to take beside full epochs.

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share the sum of all sizes; no
    target exceeds `most` times its source's size, and the excess goes to the others by weight. That
    is the level x with sum(min(most * size, x * weight)) = sum(size): with the sources in the order of
    most * size / weight, the first prefix that stays under its caps gives x. One row per source; any number of sources.
    """
    numbered = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], ["one"], "mix-names")
    weighed = numbered.withColumn("weight", F.pmod(F.col("before_one"), F.lit(3)) + 1).drop("one", "before_one")
    capped = weighed.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    ordered = running(capped, [F.col("ratio").asc(), F.col("source").asc_nulls_last()], ["cap", "weight"], "mix-ratios")
    whole = sizes.agg(F.sum("source_size").alias("total")).first()["total"] or 0
    weights = weighed.agg(F.sum("weight").alias("total")).first()["total"] or 0
    leveled = ordered.withColumn("level", (F.lit(whole) - F.col("before_cap")) / (F.lit(weights) - F.col("before_weight")))
    # The first level that its own source's cap does not cut is the common one.
    x = leveled.filter("level <= ratio").agg(F.min(F.struct("ratio", "level")).alias("first")).first()["first"]
    x = F.lit(x["level"] if x else None).cast("double")
    target = F.when(F.col("ratio") < x, F.col("cap").cast("double")).otherwise(x * F.col("weight"))
    out = leveled.withColumn("target", F.coalesce(target, F.col("cap").cast("double")))
    out = out.withColumn("budget", F.round("target").cast("long"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("full", full).withColumn("rest", F.col("budget") - full * F.col("source_size"))
    return out.select("key", "source", "source_size", "weight", "target", "full", "rest")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix-1",
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, full, taken.

    Documents get a random key by MD5 of seed, id and text. Each source is sorted by key over its key ranges, 4096 or more,
    so that a source of all rows has about RANGE_ROWS in each; the ranges' sums give every range its offset, and a running sum inside
    the range gives every document its place. A source is taken `full` times whole, and then the documents in key order
    until its budget is spent: the document at the cut gives just its first words. taken counts words,
    repeats included, at most three times the size; full is the number of whole repeats. Budgets
    are targets rounded to whole words, so a source's taken words differ from its target by less than one.

    Null or empty texts have size 0 and are taken 0 times; a null source is a source of its own, last in
    order; sources without words have target 0. Rows with one id and text tie on the key and are exchangeable.
    Other columns are not read. Empty tables give no rows. DataFrame operations only. A source with a third of all rows is 4096 window
    groups or more, and every task of its prefix sum holds one range. Reruns agree.
    """
    placed = _placed(docs, id_col, text_col, source_col, seed)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "full", (F.col("full") * F.col("size") + F.col("part")).alias("taken")
    )


def _digits(rows: int) -> int:
    digits = LEAST_DIGITS
    while digits < MOST_DIGITS and rows > RANGE_ROWS * 16**digits:
        digits += 1
    return digits


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _order(number: Column, text: Column, size: Column, seed: str) -> Column:
    """A document's place in its source's random order; no names but those of the struct."""
    place = F.md5(F.concat(F.lit(seed + " "), F.coalesce(number.cast("string"), F.lit("null")), F.lit(" "), F.md5(F.coalesce(text, F.lit("")))))
    return F.struct(place.alias("place"), size.alias("size"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """Of each row, its place in the order, its source's figures and part, the words beside full repeats."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("_text"))
    rows = rows.select("doc_id", "source", _key(F.col("source")).alias("key"), _order(F.col("doc_id"), F.col("_text"), words_in(F.col("_text")), seed).alias("order"))
    rows = written(rows.withColumn("size", F.col("order.size")), "mix")
    rows = rows.withColumn("range", F.substring("order.place", 1, _digits(rows.count())))
    ranges = rows.groupBy("key", "range").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    ranges = written(ranges, "mix-ranges")
    goals = targets(ranges.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))).drop("source")
    offset = F.sum("words").over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select("key", "range", F.coalesce(offset, F.lit(0).cast("long")).alias("offset")).join(goals, "key")
    inside = W.partitionBy("key", "range").orderBy("order")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = rows.withColumn("before", before).join(ranges, ["key", "range"])
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("offset") - F.col("before")))
    return placed.withColumn("part", part)


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix-1",
) -> DataFrame:
    """The mix itself: rows of docs, all columns, as often as mix() takes them; the document at a source's cut once
    more with its first words, joined by spaces. Texts are not shuffled: a source's row of (full, last document
    taken) decides all its documents. Its cases are those of mix(); documents without words are not taken, rows equal to the
    one at the cut are cut like it, and columns may have any names."""
    placed = _placed(docs, id_col, text_col, source_col, seed)
    last = F.max(F.when(F.col("part") > 0, F.struct("order", "part"))).alias("last")
    cuts = written(placed.groupBy("key").agg(F.first("full").alias("full"), last), "mix-cuts")
    # The documents are one struct column beside the operator's own names. Sources are few, or their cuts are joined like any other.
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(f"`{text_col}`")
    rows = docs.select(
        row.alias("row"), text.alias("words"), _key(F.col(f"`{source_col}`")).alias("key"),
        _order(F.col(f"`{id_col}`").cast("long"), text, words_in(text), seed).alias("order"),
    ).filter(F.col("words").rlike(WORD))
    rows = rows.join(F.broadcast(cuts) if cuts.count() <= 100_000 else cuts, "key")
    part = F.when(F.col("last").isNull() | (F.col("order") > F.col("last.order")), 0).when(F.col("order") < F.col("last.order"), F.col("order.size"))
    rows = rows.withColumn("part", part.otherwise(F.col("last.part")).cast("long"))
    times = F.col("full") + (F.col("part") > 0).cast("long")
    rows = rows.withColumn("time", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<long>"))))
    cut = (F.col("time") > F.col("full")) & (F.col("part") < F.col("order.size"))
    short = F.array_join(F.slice(F.regexp_extract_all("words", F.lit(WORD), F.lit(0)), 1, F.col("part").cast("int")), " ")
    rows = rows.withColumn("words", F.when(cut, short).otherwise(F.col("words")))
    return rows.select(*[F.col("words").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
