"""Conversation state: history, follow-ups, answer checks, number checks, sessions, rate limits, usage and ratings."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NUMBER = r"\d+(?:[.,]\d+)?"
# The shape of an answer, its limits, the pattern of texts that must not be in a claim, reasons and headings.
ANSWER = "struct<abstain:boolean,claims:array<struct<text:string,evidence:array<struct<id:string,quote:string>>>>>"
MOST_CLAIMS, MOST_TEXT, MOST_EVIDENCE, QUOTE = 6, 1200, 4, (20, 400)
LINK = r"https?://|\[\d+\]"
HEADINGS = ("Краткий вывод", "Подробности", "Источники")
PAGE = "PDF стр."
#: What str.rstrip takes away.
BLANKS = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def last_turns(turns: DataFrame, keep: int = 8) -> DataFrame:
    """The last turns of each conversation, with their place from the end (1: last)."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text")))
    return turns.withColumn("back", back).filter(F.col("back") <= keep)


def nth_turn(turns: DataFrame, role: str, n: int) -> DataFrame:
    """The n-th turn of a role in each conversation."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text"))
    return turns.filter(F.col("role") == role).withColumn("_n", place).filter(F.col("_n") == n).drop("_n")


def numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("."))))


def numbers_kept(current: Column, produced: Column, allowed: Column) -> Column:
    """Whether a rewrite has all numbers of the current text, and none but those of the allowed text."""
    return (F.size(F.array_except(numbers(current), numbers(produced))) == 0) & (F.size(F.array_except(numbers(produced), numbers(allowed))) == 0)


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normal(text: Column) -> Column:
    """Text for quote matching: compatibility forms, no soft hyphens, words joined that a hyphen breaks at a line's end, one kind of
    dash and of space. Only texts beyond ASCII go to Python."""
    wide = text.rlike(r"[^\x00-\x7F]")
    plain = F.when(wide, _compatible(F.when(wide, text))).otherwise(text)
    joined = F.regexp_replace(F.replace(plain, F.lit("\u00ad"), F.lit("")), r"(?<=\p{L})[-\u2010]\s*\n\s*(?=\p{L})", "")
    return F.trim(F.regexp_replace(F.translate(joined, "\u2010\u2011\u2013\u2014\u2212", "-----"), r"(?U)\s+", " "))


def checked_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers (answer_id, payload JSON) with reason, the first that applies by claim, evidence and check, else ok.

    schema_error: no object, abstain neither true nor false, claims not 1 to 6, a claim's text not 1 to 1200 characters or with a
    link or [n], evidence not 1 to 4, a quote not 20 to 400 characters; abstain; unknown_citation: an id that is no
    source, which is looked at before the quote; quote_mismatch: after normalisation the quote is shorter than 20 or not in its source.
    Sources (id, text) are those of all answers, or, with an answer_id, each answer's own.
    """
    own = ["answer_id"] if "answer_id" in sources.columns else []
    parsed = answers.withColumn("_a", F.from_json("payload", ANSWER))
    whole = (
        F.when(F.col("_a.abstain"), "abstain")
        .when(F.col("_a.abstain").isNull(), "schema_error")
        .when(F.coalesce(~F.size("_a.claims").between(1, MOST_CLAIMS), F.lit(True)), "schema_error")
    )
    parsed = parsed.withColumn("_whole", whole)
    claims = parsed.filter("_whole IS NULL").select("answer_id", F.posexplode("_a.claims").alias("_c", "_claim"))
    text, size = F.col("_claim.text"), F.size("_claim.evidence")
    bad = text.isNull() | ~F.char_length(text).between(1, MOST_TEXT) | text.rlike(LINK) | F.coalesce(~size.between(1, MOST_EVIDENCE), F.lit(True))
    claims = claims.withColumn("_bad", bad)
    first = claims.filter("_bad").select("answer_id", "_c", F.lit(-1).alias("_e"), F.lit("schema_error").alias("reason"))
    proof = claims.filter("NOT _bad").select("answer_id", "_c", F.posexplode("_claim.evidence").alias("_e", "_x"))
    proof = proof.select("answer_id", "_c", "_e", F.col("_x.id").alias("id"), F.col("_x.quote").alias("quote"))
    known = sources.select("id", *own, normal(F.col("text")).alias("_text"), F.lit(True).alias("_known"))
    proof = proof.join(known, ["id", *own], "left").withColumn("_quote", normal(F.col("quote")))
    failed = (
        F.when(F.col("_known").isNull(), "unknown_citation")
        .when(F.coalesce(~F.char_length("quote").between(*QUOTE), F.lit(True)), "schema_error")
        .when((F.char_length("_quote") < QUOTE[0]) | ~F.coalesce(F.contains("_text", "_quote"), F.lit(False)), "quote_mismatch")
    )
    second = proof.withColumn("reason", failed).filter("reason IS NOT NULL").select("answer_id", "_c", "_e", "reason")
    found = first.unionByName(second).groupBy("answer_id").agg(F.min_by("reason", F.struct("_c", "_e")).alias("reason"))
    return parsed.join(found, "answer_id", "left").select("answer_id", F.coalesce("_whole", "reason", F.lit("ok")).alias("reason"))


def page_link(url: Column, page: Column) -> Column:
    """A URL without its fragment, and the page as its anchor."""
    return F.concat(F.substring_index(url, "#", 1), F.lit("#page="), page.cast("string"))


def rendered_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, text, cited of the answers (answer_id, payload) that checked_answers finds ok: the first claim, the others, and the
    sources (id, title, page, url) by number; ids are numbered as they first occur, and a claim tells each of its numbers once."""
    a = F.from_json("payload", ANSWER)
    rows = answers.select("answer_id", a["claims"].alias("_claims"))
    ids = F.flatten(F.transform("_claims", lambda c: F.transform(c["evidence"], lambda e: e["id"])))
    rows = rows.withColumn("cited", F.array_distinct(ids))
    number = lambda e: F.concat(F.lit("["), F.array_position("cited", e["id"]).cast("string"), F.lit("]"))
    told = F.transform(
        "_claims", lambda c: F.concat(F.trim(c["text"]), F.lit(" "), F.array_join(F.array_distinct(F.transform(c["evidence"], number)), " "))
    )
    rows = rows.withColumn("_told", told)
    line = F.concat(F.lit("["), (F.col("_n") + 1).cast("string"), F.lit("] "), "title", F.lit(f", {PAGE} "), F.col("page").cast("string"), F.lit("\n"), page_link(F.col("url"), F.col("page")))
    keys = ["id", *(["answer_id"] if "answer_id" in sources.columns else [])]
    lines = rows.select("answer_id", F.posexplode("cited").alias("_n", "id")).join(sources, keys).select("answer_id", "_n", line.alias("_line"))
    lines = lines.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]).alias("_lines"))
    first, more, below = HEADINGS
    rest = F.when(F.size("_told") > 1, F.concat(F.lit(f"\n\n{more}\n"), F.array_join(F.slice("_told", 2, MOST_CLAIMS), "\n\n"))).otherwise("")
    text = F.concat(F.lit(f"{first}\n"), F.element_at("_told", 1), rest, F.lit(f"\n\n{below}\n"), F.array_join("_lines", "\n\n"))
    ok = checked_answers(answers, sources).filter("reason = 'ok'").select("answer_id")
    return rows.join(ok, "answer_id").join(lines, "answer_id").select("answer_id", text.alias("text"), "cited")


def sessions(events: DataFrame, user: str, time: str, ttl_seconds: int = 1800) -> DataFrame:
    """user, session (from 1), start, end, events: a gap of ttl_seconds or more ends a session."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = W.partitionBy(user).orderBy(time)
    gap = at - F.lag(at).over(w)
    new = F.coalesce((gap >= ttl_seconds * 1_000_000).cast("int"), F.lit(1))
    rows = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rangeBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(user, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("events"))


def rate_limited(events: DataFrame, user: str, time: str, key: str, gap_seconds: float) -> DataFrame:
    """user, key, accepted: an event is accepted if the last accepted one of its user is gap_seconds old or more.

    Users are sorted within partitions and folded row by row; only one user's last time is held.
    """
    rows = events.select(F.col(user).alias("u"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(key).alias("k"))
    rows = rows.repartition("u").sortWithinPartitions("u", "t", "k")
    gap = int(gap_seconds * 1_000_000)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last = object(), 0
        for pdf in parts:
            accepted = []
            for u, t in zip(pdf["u"], pdf["t"], strict=True):
                ok = u != who or t - last >= gap
                who, last = u, t if ok else last
                accepted.append(ok)
            yield pd.DataFrame({"u": pdf["u"], "k": pdf["k"], "accepted": accepted})

    return rows.mapInPandas(fold, "u long, k long, accepted boolean").toDF(user, key, "accepted")


def runtime_summary(requests: DataFrame) -> DataFrame:
    """By reason: requests, technical failures, median and linear 95th percentile of the time, known cost."""
    return requests.groupBy("reason").agg(
        F.count("*").alias("requests"),
        F.count_if("technical").alias("technical"),
        F.percentile("elapsed", 0.5).alias("median"),
        F.percentile("elapsed", 0.95).alias("p95"),
        F.sum("cost").alias("cost"),
    )


def usage_cost(calls: DataFrame, key: str, hit: float, miss: float, out: float) -> DataFrame:
    """Tokens and cost by key; the cost is null unless every call was observed and its cache use known."""
    cost = (F.sum("cache_hit") * hit + F.sum("cache_miss") * miss + F.sum("completion") * out) / 1e6
    known = (F.count_if(~F.col("observed")) == 0) & (F.count(F.lit(1)) == F.count("cache_hit")) & (F.count(F.lit(1)) == F.count("cache_miss"))
    return calls.groupBy(key).agg(F.count("*").alias("calls"), F.sum("completion").alias("completion"), F.when(known, cost).alias("cost"))


def rating_summary(ratings: DataFrame, by: str, flags: list[str]) -> DataFrame:
    """Of 0/1 flags, null where they do not apply: how many apply, how many are 1, and the share."""
    long = ratings.unpivot([by], flags, "flag", "value").filter("value IS NOT NULL")
    return long.groupBy(by, "flag").agg(F.count("*").alias("applicable"), F.count_if(F.col("value") == 1).alias("positive"), F.avg("value").alias("share"))


def first_occurrences(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, value, place: distinct values of a key by where they first occur."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_at"))
    return first.select(key, value, F.row_number().over(W.partitionBy(key).orderBy("_at", value)).alias("place"))


def split_message(text: str, most: int = 1800) -> list[str]:
    """Parts of at most so many characters, one at least. A part ends at the last newline if that is in the second half of what fits,
    else at the last space, else where it is full; newlines and spaces between parts go, and leading ones of the text stay."""
    if most < 1:
        raise ValueError("a part has a character at least")
    parts, rest = [], text
    while len(rest) > most:
        fits = rest[: most + 1]
        ends = [i for i, least in ((fits.rfind("\n"), max(1, most // 2)), (fits.rfind(" "), 1)) if i >= least]
        head, rest = rest[: ends[0] if ends else most].rstrip(), rest[ends[0] if ends else most :].lstrip("\n ")
        parts += [head] * bool(head)
    return parts + [rest] * bool(rest or not parts)


def split_messages(rows: DataFrame, key: str, text: str, most: int = 1800) -> DataFrame:
    """key, part (from 0), text: split_message as one pattern, whose matches are the parts with the newlines and spaces after them."""
    if most < 1:
        raise ValueError("a part has a character at least")
    cut = rf"(?s).{{1,{most}}}+\z|(?:.{{{max(1, most // 2)},{most}}}(?=\n)|.{{1,{most}}}(?= )|.{{{most}}})[\n ]*+"
    got = rows.select(F.col(key).alias("k"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(cut), F.lit(0)).alias("m"))
    # What is left at last, of at most so many characters with its blanks, stays as it is.
    rest = lambda p, i: (i == F.size("m") - 1) & (F.char_length(p) <= most)
    parts = F.filter(F.transform("m", lambda p, i: F.when(rest(p, i), p).otherwise(F.rtrim(p, F.lit(BLANKS)))), lambda p: p != "")
    got = got.select("k", F.posexplode_outer(parts).alias("part", "text"))
    return got.select(F.col("k").alias(key), F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
