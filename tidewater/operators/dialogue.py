"""Rules of a conversation about reports: scope, follow-ups, retrieval hints, questions about citations, gates and messages.

The patterns are fixed values of the language that the rules are for; every rule takes others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Patterns of questions, replacements, hints, limits, reasons and messages.
POINTS_BACK = (
    r"(?iu)(?U)\b(этого|этой|этот|эти|такие|такого|там|здесь|выше|ранее|предыдущ\w*|перв\w*\s+ответ\w*|за\s+этот\s+период|"
    r"основн\w+\s+вклад|этот\s+рост)\b"
)
BEGINS_AS_FOLLOW_UP = (
    r"(?iu)(?U)^(а\s+|и\s+|почему\s+(так|это)|что\s+это\s+значит|уточни\b|подробнее\b|какие\s+(основные\s+)?причины\b|"
    r"какие\s+страны\b|какой\s+рост\b|насколько\s+увелич)"
)
MOST_FOLLOW_UP_WORDS = 16
YEAR = r"\b((?:19|20)\d{2})\b"
CLARIFIED, SOURCES = "\nУточнение: ", "\nИсточники: "
MOST_PREVIOUS, MOST_QUERY = 1800, 4000
WHY = r"(?iu)(?U)^почему\b"
DIRECTION = (
    r"(?iu)(?U)\b(снизил(?:ся|ась|ось|ись)|снижал(?:ся|ась|ось|ись)?|снижение|упал(?:а|о|и)?|падение|уменьшил(?:ся|ась|ось|ись)|уменьшение|"
    r"вырос(?:ла|ло|ли)?|рост|увеличил(?:ся|ась|ось|ись)|увеличение)\b"
)
CHANGE = "изменение"
HINTS = [
    (r"миров|глобал", "global"),
    (r"электроэнерг|электричеств", "electricity"),
    (r"спрос|потреблен", "demand"),
    (r"рост|вырос|увелич|сниз|сократ|паден|измен", "change"),
    (r"причин|фактор", "drivers"),
    (r"прогноз|ожида", "forecast"),
    (r"генерац|выработ", "generation"),
    (r"возобнов", "renewables"),
    (r"китай", "China"),
    (r"инд", "India"),
    (r"сша|соединенн", "United States"),
    (r"европ|(?<![а-яё])ес(?![а-яё])", "Europe"),
    (r"brent|брент", "Brent"),
    (r"нефт", "oil"),
    (r"цен", "price"),
    (r"т\s*вт[·\s-]*ч|тwh|twh", "TWh"),
]
HINT_NUMBER = r"\d+(?:[.,]\d+)?%?"
ASKS_SOURCE = r"(?iu)(?U)\b(источник|страниц|откуда|ссылк)\w*\b"
ORDINALS = [rf"(?iu)(?U)\b{stem}\w*\s+(?:ответ|сообщен|утвержден|информац)\w*" for stem in ("перв", "втор", "трет")]
POINTS_AT_ANSWER = "|".join([r"(?iu)(?U)\b(?:это|этого|этой|этих|такое|выше|ранее|предыдущ\w*|последн\w*)\b", *ORDINALS])
ANSWER_WORD = r"(?iu)(?U)\bответ\w*\b"
WHERE_IS_THIS = r"(?iu)(?U)\bгде\b.{0,30}\b(это|такое|выше|ранее)\b"
WHERE_SAID = r"(?iu)(?U)\bгде\b.{0,20}\b(напис|указ|сказ|взя)\w*"
MOST_META_WORDS = 5
KEY_SHAPE = r"^[A-Za-z0-9_-]{16,256}$"
MOST_QUESTION = 2000
REMEMBERED = ["ok", "abstain", "no_hits", "unsupported_claim", "off_topic_answer"]
FAILURES = {
    "access": "Провайдер отклонил доступ. Отправь /start и проверь ключ.",
    "balance": "Провайдер не выполнил запрос: проверь баланс и доступ к модели.",
    "limit": "Сейчас достигнут лимит запросов провайдера. Попробуй чуть позже.",
    "timeout": "Провайдер не успел ответить. Попробуй повторить вопрос чуть позже.",
    "other": "Не получилось получить ответ от API. Попробуй чуть позже; это не означает, что сведений нет в документах.",
}


def words_in(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def scope(text: Column, aliases: dict[str, list[str]]) -> Column:
    """The sources, in order of name, one of whose aliases a text holds, whatever the case."""
    if not aliases:
        return F.array().cast("array<string>")
    held = [F.when(F.exists(F.array(*map(F.lit, names)), lambda a: F.contains(F.lower(text), F.lower(a))), F.lit(source)) for source, names in sorted(aliases.items())]
    return F.array_compact(F.array(*held))


def leans_back(text: Column, points: str = POINTS_BACK, begins: str = BEGINS_AS_FOLLOW_UP) -> Column:
    """Whether a short question points to what was said before, or begins like a question that goes on."""
    asked = F.trim(text)
    return (words_in(asked) <= MOST_FOLLOW_UP_WORDS) & (asked.rlike(points) | asked.rlike(begins))


def without_years(text: Column, kept: Column) -> Column:
    """text without its years but those of the array kept, spaces closed up."""
    pieces = F.split(F.regexp_replace(text, YEAR, "\x01$1\x02"), "[\x01\x02]", -1)
    left = F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & ~F.array_contains(kept, p), F.lit("")).otherwise(p))
    return F.trim(F.regexp_replace(F.array_join(left, ""), r"\s{2,}", " "))


def resolved_questions(turns: DataFrame, aliases: dict[str, list[str]], points: str = POINTS_BACK, begins: str = BEGINS_AS_FOLLOW_UP) -> DataFrame:
    """turns (conv_id, turn, question) with leans and resolved, the question to search for.

    A question that names no source and leans back is put behind the one before it as that was asked, cut to its first characters
    and without its years if the new one has a year (years in the aliases of its sources stay), and with the sources it names.
    """
    before = F.lag("question").over(W.partitionBy("conv_id").orderBy("turn", "question"))
    rows = turns.withColumn("_before", before)
    leans = F.col("_before").isNotNull() & (F.size(scope(F.col("question"), aliases)) == 0) & leans_back(F.col("question"), points, begins)
    rows = rows.withColumns({"leans": F.coalesce(leans, F.lit(False)), "_scope": scope(F.col("_before"), aliases)})
    years = {source: sorted({y for a in [source, *names] for y in _years(a)}) for source, names in aliases.items()}
    table = F.create_map(*[x for s, y in years.items() for x in (F.lit(s), F.array(*map(F.lit, y)).cast("array<string>"))]) if years else F.lit(None)
    kept = F.flatten(F.transform("_scope", lambda s: F.coalesce(table[s], F.array().cast("array<string>")))) if years else F.array().cast("array<string>")
    rows = rows.withColumn("_kept", kept)
    previous = F.when(F.col("question").rlike(YEAR), without_years(F.col("_before"), F.col("_kept"))).otherwise(F.col("_before"))
    whole = F.concat(F.substring(previous, 1, MOST_PREVIOUS), F.lit(CLARIFIED), F.trim("question"), F.lit(SOURCES), F.array_join("_scope", " "))
    return rows.withColumn("resolved", F.when(F.col("leans"), F.right(whole, F.lit(MOST_QUERY))).otherwise(F.trim("question"))).drop("_before", "_scope", "_kept")


def _years(alias: str) -> list[str]:
    import re

    return re.findall(r"(?<!\d)(?:19|20)\d{2}(?!\d)", alias)


def neutral(text: Column) -> Column:
    """A question why something rose or fell as one about its change, so that either direction can be found."""
    raw = F.trim(text)
    said = F.regexp_replace(F.regexp_replace(raw, r"(?iu)^почему\s+", ""), DIRECTION, CHANGE)
    said = F.btrim(F.regexp_replace(said, r"\s{2,}", " "), F.lit(" ?"))
    return F.when(raw.rlike(WHY) & (said != ""), said).otherwise(raw)


def hints(text: Column, table: list[tuple[str, str]] | None = None) -> Column:
    """Search words of the other language for the stems in a text, in the table's order, then the text's numbers with a point."""
    found = [F.when(text.rlike(f"(?iu){pattern}"), F.lit(word)) for pattern, word in table or HINTS]
    numbers = F.transform(F.regexp_extract_all(text, F.lit(HINT_NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")))
    return F.array_join(F.array_distinct(F.concat(F.array_compact(F.array(*found)), numbers)), " ")


def asks_about_citations(text: Column, named: Column) -> Column:
    """Whether a question is about the sources of an answer given before; named: the sources that it names itself."""
    strong, source, here = text.rlike(POINTS_AT_ANSWER), text.rlike(ASKS_SOURCE), text.rlike(WHERE_IS_THIS)
    alone = F.size(named) == 0
    short = alone & (words_in(text) <= MOST_META_WORDS) & (source | text.rlike(WHERE_SAID))
    return (source | here | short) & (alone | strong) & (strong | text.rlike(ANSWER_WORD) | here | short)


def asked_answer(text: Column) -> Column:
    """The number of the answer that a question names, from 1; 0 for the last one."""
    out = F.lit(0)
    for i, pattern in reversed(list(enumerate(ORDINALS, 1))):
        out = F.when(text.rlike(pattern), i).otherwise(out)
    return out


def citation_answers(questions: DataFrame, turns: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """question_id, turn, outcome, text for the questions (question_id, conv_id, text) about citations: the sources of the turn asked
    for, from turns (conv_id, turn from 1, sources array<struct<title, page, url>>), numbered in their order.

    outcome: sources; no_answer, where the conversation has no such turn; no_sources, where the turn cited none.
    """
    rows = questions.filter(asks_about_citations(F.col("text"), scope(F.col("text"), aliases))).withColumn("_asked", asked_answer(F.col("text")))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    rows = rows.join(last, "conv_id").withColumn("turn", F.when(F.col("_asked") == 0, F.col("_last")).otherwise(F.col("_asked")))
    rows = rows.drop("text").join(turns.select("conv_id", "turn", F.lit(True).alias("_there"), "sources"), ["conv_id", "turn"], "left")
    count = F.coalesce(F.when(F.col("sources").isNotNull(), F.size("sources")), F.lit(0))
    line = lambda s, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] "), s["title"], F.coalesce(F.concat(F.lit(", PDF стр. "), s["page"].cast("string")), F.lit("")),
        F.when(F.coalesce(s["url"], F.lit("")) == "", "").otherwise(
            F.concat(F.lit("\n"), F.substring_index(s["url"], "#", 1), F.coalesce(F.concat(F.lit("#page="), s["page"].cast("string")), F.lit("")))
        ),
    )
    outcome = F.when(F.col("_there").isNull(), "no_answer").when(count == 0, "no_sources").otherwise("sources")
    text = F.when(count > 0, F.array_join(F.transform("sources", line), "\n\n"))
    return rows.select("question_id", "turn", outcome.alias("outcome"), text.alias("text"))


def context_window(turns: DataFrame, keep: int = 3) -> DataFrame:
    """conv_id, turn, question, resolved, claims, titles, reason of the last turns (conv_id, turn, question, resolved, claims
    array<string>, sources array<struct<title>>, reason), each cut to its length, for resolving references and not as facts."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = turns.withColumn("_b", back).filter(F.col("_b") <= keep)
    claims = F.transform(F.filter(F.slice("claims", 1, 6), lambda c: F.trim(c) != ""), lambda c: F.substring(c, 1, 1000))
    titles = F.slice(F.array_distinct(F.transform(F.filter("sources", lambda s: F.coalesce(s["title"], F.lit("")) != ""), lambda s: F.substring(s["title"], 1, 300))), 1, 4)
    cut = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    return rows.select(
        "conv_id", "turn", cut("question", 1200).alias("question"), F.substring(F.coalesce("resolved", "question"), 1, MOST_PREVIOUS).alias("resolved"),
        claims.alias("claims"), titles.alias("titles"), cut("reason", 64).alias("reason"),
    )


def remembered(turns: DataFrame, keep: int = 8) -> DataFrame:
    """The last turns of each conversation whose reason may be remembered; the oldest go first."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.filter(F.col("reason").isin(REMEMBERED)).withColumn("_b", back).filter(F.col("_b") <= keep).drop("_b")


def key_shaped(text: Column) -> Column:
    """Whether a text looks like an access key."""
    return F.coalesce(F.trim(text).rlike(KEY_SHAPE), F.lit(False))


def question_allowed(text: Column) -> Column:
    return F.coalesce(F.char_length(F.trim(text)).between(1, MOST_QUESTION), F.lit(False))


def failure_message(status: Column, reason: Column) -> Column:
    """A fixed message for a provider's status, so that nothing of its answer is told."""
    kinds = F.when(status.isin(401, 403), "access").when(status == 402, "balance").when(status == 429, "limit").when(reason == "timeout", "timeout").otherwise("other")
    return F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])[kinds]


class Entrance:
    """Who is at the key entry: at most `capacity` users at a time, each for ttl_seconds. State of the driver, as large as capacity."""

    def __init__(self, capacity: int = 100, ttl_seconds: float = 300):
        self.capacity, self.ttl, self.since = capacity, ttl_seconds, {}

    def admit(self, user, now: float) -> bool:
        """Whether the user is let in; a user who is there begins anew."""
        self.since = {u: t for u, t in self.since.items() if now - t <= self.ttl}
        if user not in self.since and len(self.since) >= self.capacity:
            return False
        self.since[user] = now
        return True

    def holds(self, user, now: float) -> bool:
        return user in self.since and now - self.since[user] <= self.ttl


def expired_entries(starts: DataFrame, now: Column, ttl_seconds: int = 300) -> DataFrame:
    """starts (user_id, ts) with expired: the entry is older than its time to live."""
    return starts.withColumn("expired", F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > ttl_seconds * 1_000_000)
