"""Questions, experiments and ratings of an evaluation: locked splits, altered contexts, call budgets, strict counts."""

from __future__ import annotations

import hashlib
import itertools
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The state of a question that may be scored, the kind that may not, and the columns of ratings.
VERIFIED, INJECTION = "gold_verified", "injection"
QUESTION = (
    "id string, question string, query_en string, split string, group_id string, status string, kind string, "
    "retrieval_gold array<struct<source_id:string,pages:array<int>>>"
)


def read_questions(spark: SparkSession, path: str, split: str, manifest: str | None = None) -> DataFrame:
    """The questions of a split. With a manifest (questions_sha256, groups) the file must have its hash and every group its split."""
    text = Path(path).read_bytes()
    rows = json.loads(text)
    if manifest is not None:
        locked = json.loads(Path(manifest).read_text())
        if hashlib.sha256(text).hexdigest() != locked["questions_sha256"]:
            raise ValueError("the questions are not those that were split")
        if any(locked["groups"].get(q["group_id"]) != q["split"] for q in rows):
            raise ValueError("a group has left its split")
    chosen = [json.dumps(q) for q in rows if q["split"] == split]
    return spark.createDataFrame([(q,) for q in chosen], "q string").select(F.from_json("q", QUESTION).alias("q")).select("q.*")


def eligible(questions: DataFrame) -> DataFrame:
    """questions with may_score: the gold is verified and not empty, and the question is no injection."""
    able = (F.col("status") == VERIFIED) & (F.coalesce(F.size("retrieval_gold"), F.lit(0)) > 0) & (F.col("kind") != INJECTION)
    return questions.withColumn("may_score", F.coalesce(able, F.lit(False)))


def picked(questions: DataFrame, ids: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Questions of the given ids, all of which must be there, and the first of them by id: a run's budget of questions."""
    out = questions if ids is None else questions.filter(F.col("id").isin(ids))
    if ids is not None and out.select("id").distinct().count() != len(set(ids)):
        raise ValueError("an id is not in this split")
    return out if most is None else out.orderBy("id").limit(most)


def altered(hits: DataFrame, variant: str, chunks: DataFrame | None = None, gold: list[str] = (), instruction: str = "", old: str = "", new: str = "") -> DataFrame:
    """Copies of hits (rank, id, source_id, text) for a test of what an answer may use.

    injection: an instruction before the first hit's text. counterfactual: old text replaced by new in all hits, one of which must have it. wrong_fragment:
    only the first chunk by id of a source that is not in gold, with more than 100 characters.
    """
    if variant == "injection":
        return hits.withColumn("text", F.when(F.col("rank") == 1, F.concat(F.lit(f"{instruction}\n"), "text")).otherwise(F.col("text")))
    if variant == "counterfactual":
        if hits.filter(F.contains("text", F.lit(old))).isEmpty():
            raise ValueError("no hit has the text to replace")
        return hits.withColumn("text", F.replace("text", F.lit(old), F.lit(new)))
    if variant == "wrong_fragment":
        other = chunks.filter(~F.col("source_id").isin(list(gold)) & (F.char_length("text") > 100)).orderBy("id").limit(1)
        if other.isEmpty():
            raise ValueError("no other fragment is there")
        return other.select(F.lit(1).alias("rank"), "id", "source_id", "text")
    return hits


def configurations(**options: list) -> list[dict]:
    """Every combination of options, the last one changing first."""
    return [dict(zip(options, values, strict=True)) for values in itertools.product(*options.values())]


class CallBudget:
    """Calls of a client up to a number; a call counts before it is made."""

    def __init__(self, call, most: int):
        self.call, self.left = call, most

    def __call__(self, *args, **kwargs):
        if self.left <= 0:
            raise RuntimeError("the calls are spent")
        self.left -= 1
        return self.call(*args, **kwargs)


def write_lines(rows: list[dict], path: str) -> None:
    """JSON lines in a file that must not exist."""
    with open(path, "x", encoding="utf-8") as out:
        out.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are left out, and one that cannot be read is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of ratings, all columns as text, empty fields as empty texts."""
    return spark.read.options(header="true", inferSchema="false", nullValue="\u0000", emptyValue="").csv(path)


def strict_counts(ratings: DataFrame, flags: list[str], required: tuple[str, ...] = (), parts: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """One row of reviewed ratings: reviewed, and <flag>_n and <flag>_yes of each flag that is 0 or 1; required flags must be, and of each (whole,
    part) pair of numbers the sums, where 0 <= part <= whole. ValueError for rows that break a rule."""
    rows = ratings.filter("reviewed = '1'")
    bit = lambda c: F.col(c).isin("0", "1")
    whole_number = lambda c: F.expr(f"try_cast(`{c}` AS int)")
    bad = F.lit(False)
    for c in required:
        bad = bad | ~F.coalesce(bit(c), F.lit(False))
    for whole, part in parts:
        told = (F.coalesce(F.col(whole), F.lit("")) != "") & (F.coalesce(F.col(part), F.lit("")) != "")
        bad = bad | (told & ~F.coalesce(whole_number(part).between(0, whole_number(whole)), F.lit(False)))
    if not rows.filter(bad).isEmpty():
        raise ValueError("a reviewed field is not 0 or 1, or a part exceeds its whole")
    counts = [x for c in flags for x in (F.count_if(bit(c)).alias(f"{c}_n"), F.count_if(F.col(c) == "1").alias(f"{c}_yes"))]
    both = lambda a, b, c: F.sum(F.when((F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != ""), whole_number(c)))
    sums = [F.coalesce(both(w, p, c), F.lit(0)).alias(f"{c}_sum") for w, p in parts for c in (w, p)]
    return rows.agg(F.count("*").alias("reviewed"), *counts, *sums)
