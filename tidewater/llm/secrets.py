"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base kinds, their patterns and the least lengths.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same matches as AKIA[A-Z0-9]+ of at least 18 characters
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
KEYWORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]

#: A candidate of the Markov models; as long as the shortest base match without a keyword.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
#: Letters of the models; other characters are not in candidates.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Least log-likelihood ratio, in nats for each character, at which a candidate is a secret.
LEAST_RATIO = 0.3

#: Parts of ordinary identifiers, from which the labelled samples are composed.
PARTS = (
    "account action address agent algorithm amount application array article available balance batch before between binary "
    "boundary browser buffer builder button cache calendar callback cancel category channel character check client cluster "
    "code collection column command comment commit component computer config connection console constant container content "
    "context control convert counter country create current customer data database date default delete description device "
    "document domain download driver element email employee encode engine entity environment error event exception execute "
    "factory feature field file filter folder format function gateway generate group handler header history identifier image "
    "index information input instance integer interface internal iterator journal kernel keyboard language layout length "
    "library limit listener location machine manager memory message method module monitor network number object operation "
    "option order output package parameter partition password payment pending pipeline position process product project "
    "property protocol provider query random record register release remote report request resource response result return "
    "schedule schema search section security select sequence server service session setting signature source statement status "
    "storage stream string structure style summary support system table target template thread time token transaction update "
    "upload user validate value variable vector version window worker "
    "und nicht werden einer gesellschaft verantwortung entwicklung zeitung freundlich schreiben que pour dans cette gouvernement "
    "développement aujourdhui maintenant nouveau bonheur para como cuando desarrollo gobierno nuevo ciudad información trabajo"
).split()


def _coded(text: Column, i: Column) -> Column:
    return F.instr(F.lit(LETTERS), F.substring(text, i, F.lit(1))) - 1


def labelled_samples(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """sample string, random boolean: digests in Base64 and in letters and digits, and identifiers of two to
    four PARTS in the usual spellings, some with a number. Made from row numbers alone."""
    n = spark.range(rows).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    parts = F.array(*map(F.lit, PARTS))
    part = lambda k: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    some = F.slice(F.array(*[part(k) for k in range(4)]), 1, (F.pmod("id", F.lit(3)) + 2).cast("int"))
    style = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(6))
    name = (
        F.when(style == 0, F.array_join(some, "_"))
        .when(style == 1, F.array_join(some, "-"))
        .when(style == 2, F.upper(F.array_join(some, "_")))
        .when(style == 3, F.array_join(F.transform(some, F.initcap), ""))
        .when(style == 4, F.concat(F.lit("/"), F.array_join(some, "/")))
        .otherwise(F.concat(F.array_join(some, ""), F.pmod("id", F.lit(100)).cast("string")))
    )
    raw = F.when(F.pmod("id", F.lit(2)) == 0, F.base64(F.unhex("h"))).otherwise(F.regexp_replace(F.base64(F.unhex("h")), "[+/=]", ""))
    return n.select(F.regexp_replace(raw, "=", "").alias("sample"), F.lit(True).alias("random")).unionByName(
        n.select(name.alias("sample"), F.lit(False).alias("random"))
    )


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, random against ordinary, by add-one smoothed Markov chains
    over LETTERS; entry (a, b) at a * len(LETTERS) + b. Only these 66 * 66 numbers reach the driver."""
    k = len(LETTERS)
    clean = samples.filter("sample IS NOT NULL AND random IS NOT NULL AND length(sample) > 1")
    pairs = clean.select("random", F.expr("sequence(1, length(sample) - 1)").alias("at"), "sample").select(
        "random", F.explode("at").alias("i"), "sample"
    )
    coded = pairs.select("random", _coded(F.col("sample"), F.col("i")).alias("a"), _coded(F.col("sample"), F.col("i") + 1).alias("b"))
    counts = coded.filter("a >= 0 AND b >= 0").groupBy("random", "a", "b").count().collect()
    import numpy as np

    seen = np.ones((2, k, k))
    for r in counts:
        seen[int(r["random"]), r["a"], r["b"]] += r["count"]
    chance = np.log(seen / seen.sum(2, keepdims=True))
    return (chance[1] - chance[0]).ravel().tolist()


SPAN = "array<struct<start:int,end:int,match:string>>"


def _scan(values: Column, step, kind: str) -> Column:
    """Of each value the fold of those before it, from 0. Values are folded in blocks of about the square root of their number, so
    that appending to a fold's result costs that root and not the number."""
    root = F.ceil(F.sqrt(F.size(values))).cast("int")
    blocks = F.transform(
        F.when(F.size(values) > 0, F.sequence(F.lit(0), F.ceil(F.size(values) / root).cast("int") - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.slice(values, k * root + 1, root),
    )
    empty = F.struct(F.lit(0).cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def fold(array: Column, value) -> Column:
        return F.aggregate(array, empty, lambda acc, x: F.struct(step(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    inner = F.transform(blocks, lambda b: fold(b, lambda x: x))
    outer = fold(inner, lambda x: x["at"])["out"]
    return F.flatten(F.zip_with(inner, outer, lambda x, before: F.transform(x["out"], lambda v: step(before, v))))


def _pieces(condition: Column, text: Column, pattern: str) -> Column:
    """The text cut around the leftmost matches that do not overlap: matches are put between U+0001 and U+0002, which the text
    has as U+0003. Every second piece is a match; without the condition there is none."""
    return F.when(condition, F.split(F.regexp_replace(text, pattern, "\x01$0\x02"), "[\x01\x02]", -1)).otherwise(F.array().cast("array<string>"))


def _lengths(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.char_length(p))


def _spans(pieces: Column, places: Column) -> Column:
    """array<struct<start, end, match>> of the matches among pieces that begin at places, in code points, end exclusive."""
    every = F.zip_with(pieces, places, lambda p, at: F.struct(at.alias("start"), (at + F.char_length(p)).alias("end"), p.alias("match")))
    return F.filter(every, lambda _, i: i % 2 == 1).cast(SPAN)


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of struct<start, rank, kind, end> in order of start, then kind.

    Kinds assign, access and hex are the fixed patterns over the whole text, leftmost and not overlapping within
    a kind. Kind markov adds the longest runs of 16 or more characters [A-Za-z0-9+/_-] that overlap no span of the fixed
    kinds and whose character pairs have a mean log-likelihood ratio, random strings against ordinary identifiers,
    of least_ratio or more. Positions are code points, ends exclusive. Equal starts are in the order of kinds.

    Null and empty texts have no spans; null ids and repeated rows stay as they are. The characters U+0001
    and U+0002 in a text count as others that no pattern matches. Other columns are not read. Empty tables give no
    rows. DataFrame operations only, row by row: no shuffle. A text of n matches takes about n ** 1.5 steps.
    """
    raw = F.coalesce(F.col("_text"), F.lit(""))
    text = F.replace(F.replace(raw, F.lit("\x01"), F.lit("\x03")), F.lit("\x02"), F.lit("\x03"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    rows = rows.select("doc_id", text.alias("_text"))
    folded = F.lower("_text")
    keyed = F.lit(False)
    for k in KEYWORDS:
        keyed = keyed | F.contains(folded, F.lit(k))
    tests = {
        "assign": (keyed, ASSIGN),
        "access": (F.contains("_text", F.lit("AKIA")), ACCESS),
        "hex": (F.col("_text").rlike(HEX), HEX),
        "runs": (F.col("_text").rlike(CANDIDATE), CANDIDATE),
    }
    rows = rows.select("doc_id", *[_pieces(when, F.col("_text"), pattern).alias(k) for k, (when, pattern) in tests.items()])
    rows = rows.withColumns({f"{k}_n": _lengths(F.col(k)) for k in tests})
    rows = rows.withColumns({f"{k}_at": _scan(F.col(f"{k}_n"), lambda a, b: a + b, "int") for k in tests})
    rows = rows.select("doc_id", *[_spans(F.col(k), F.col(f"{k}_at")).alias(k) for k in tests])
    kept = F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 1)) >= LEAST_VALUE)
    kind = lambda spans, rank, name: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(name).alias("kind"), s["end"].alias("end"))
    )
    rows = rows.withColumn("base", F.concat(kind(kept, 0, "assign"), kind(F.col("access"), 1, "access"), kind(F.col("hex"), 2, "hex")))
    # Runs by their end among base spans by their start: a run is free if no base span before it ends beyond its start.
    line = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("base"), s["end"].alias("end"), F.lit(None).cast("string").alias("match"))),
        F.transform("runs", lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("base"), s["start"].alias("end"), s["match"].alias("match"))),
    )
    rows = rows.withColumn("line", F.when(F.size("runs") > 0, F.array_sort(line)).otherwise(F.slice(line, 1, 0)))
    rows = rows.withColumn("ends", F.transform("line", lambda u: F.when(u["base"] == 1, u["end"]).otherwise(0)))
    rows = rows.withColumn("reach", _scan(F.col("ends"), F.greatest, "int"))
    free = F.filter(
        F.zip_with("line", "reach", lambda u, r: F.struct(u["end"].alias("start"), u["at"].alias("end"), u["match"].alias("match"), ((u["base"] == 0) & (r <= u["end"])).alias("free"))),
        lambda u: u["free"],
    )
    table, size = F.array(*map(F.lit, ratios)), len(LETTERS)

    def score(match: Column) -> Column:
        codes = F.transform(F.split(match, ""), lambda c: F.instr(F.lit(LETTERS), c) - 1)
        pairs = F.zip_with(codes, F.concat(F.slice(codes, 2, F.size(codes)), F.array(F.lit(None).cast("int"))), lambda a, b: a * size + b)
        return F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.when(i.isNull(), 0.0).otherwise(F.get(table, i)))

    random = F.filter(free, lambda s: score(s["match"]) >= least_ratio * (F.char_length(s["match"]) - 1))
    rows = rows.withColumn("markov", F.when(F.size("runs") > 0, kind(random, 3, "markov")).otherwise(F.slice("base", 1, 0)))
    return rows.select("doc_id", F.array_sort(F.concat("base", "markov")).alias("spans"))


def secret_report(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text, kind:start:end by start, then kind."""
    found = secret_scan(docs, ratios, id_col, text_col)
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_told(base), 256).alias("base_sha256"),
        _told(F.col("spans")).alias("spans"),
    )
