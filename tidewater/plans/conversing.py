"""Queries of conversations, events by user, labels and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tidewater.operators import conversations as co
from tidewater.operators import dialogue as di
from tidewater.plans.catalog import query, shown, told
from tidewater.session import table
from tidewater.streaming import state


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC)::INT AS back FROM conversations QUALIFY back <= 8")
def history_last(spark, sf):
    return co.last_turns(table(spark, sf, "conversations"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 2")
def second_answer(spark, sf):
    return co.nth_turn(table(spark, sf, "conversations"), "assistant", 2)


#: Rules in the words of the tables: aliases of sources with years, pointing words, hints.
ALIASES = {"plan_2024": ["schst", "plan 2024"], "review": ["tion", "ment"]}
POINTS, BEGINS = r"(?i)(?U)\b(et|und|the|los)\b", r"(?i)(?U)^(a|e|i)"
HINT_TABLE = [("keit|heit", "abstract"), ("tion", "action"), ("ing", "going"), ("ción", "accion")]

U = r"""
WITH u0 AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN text || ' 2023 2024' ELSE text END AS question FROM conversations WHERE role = 'user'),
u AS (SELECT *, lag(question) OVER (PARTITION BY conv_id ORDER BY turn, question) AS b, trim(question) AS q,
  len(list_filter(string_split_regex(trim(question), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS words FROM u0),
sc AS (SELECT *,
  list_filter([CASE WHEN contains(lower(question), 'schst') OR contains(lower(question), 'plan 2024') THEN 'plan_2024' END,
    CASE WHEN contains(lower(question), 'tion') OR contains(lower(question), 'ment') THEN 'review' END], lambda x: x IS NOT NULL) AS s,
  list_filter([CASE WHEN contains(lower(b), 'schst') OR contains(lower(b), 'plan 2024') THEN 'plan_2024' END,
    CASE WHEN contains(lower(b), 'tion') OR contains(lower(b), 'ment') THEN 'review' END], lambda x: x IS NOT NULL) AS bs FROM u),
l AS (SELECT *, coalesce(b IS NOT NULL AND len(s) = 0 AND words <= 16 AND
    (regexp_matches(q, '(?i)(^|[^\pL\pN_])(et|und|the|los)($|[^\pL\pN_])') OR regexp_matches(q, '(?i)^(a|e|i)')), false) AS leans FROM sc),
p AS (SELECT *, CASE WHEN NOT regexp_matches(question, '\b(19|20)\d{2}\b') THEN b
    WHEN list_contains(bs, 'plan_2024') THEN trim(regexp_replace(replace(replace(b, '2023', ''), '2022', ''), '\s{2,}', ' ', 'g'))
    ELSE trim(regexp_replace(regexp_replace(b, '\b(19|20)\d{2}\b', '', 'g'), '\s{2,}', ' ', 'g')) END AS previous FROM l)
"""


@query(
    U
    + """SELECT conv_id, turn, leans,
  CASE WHEN leans THEN right(substring(previous, 1, 1800) || chr(10) || 'Уточнение: ' || q || chr(10) || 'Источники: ' || array_to_string(bs, ' '), 4000) ELSE q END AS resolved FROM p"""
)
def follow_ups(spark, sf):
    asked = table(spark, sf, "conversations").filter("role = 'user'")
    text = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" 2023 2024"))).otherwise(F.col("text"))
    out = di.resolved_questions(asked.select("conv_id", "turn", text.alias("question")), ALIASES, POINTS, BEGINS)
    return out.select("conv_id", "turn", "leans", "resolved")


@query(
    r"""SELECT conv_id, turn, array_to_string(list_filter([
  CASE WHEN regexp_matches(text, '(?i)keit|heit') THEN 'abstract' END, CASE WHEN regexp_matches(text, '(?i)tion') THEN 'action' END,
  CASE WHEN regexp_matches(text, '(?i)ing') THEN 'going' END, CASE WHEN regexp_matches(text, '(?i)ción') THEN 'accion' END,
  conv_id::VARCHAR || '.5%'], lambda x: x IS NOT NULL), ' ') AS hints FROM (SELECT conv_id, turn, regexp_replace(text, '[0-9]', '', 'g') AS text FROM conversations)"""
)
def search_hints(spark, sf):
    text = F.concat(F.regexp_replace("text", "[0-9]", ""), F.lit(" "), F.col("conv_id").cast("string"), F.lit(",5%"))
    return table(spark, sf, "conversations").select("conv_id", "turn", di.hints(text, HINT_TABLE).alias("hints"))


@query(
    """WITH c AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN ' ' || repeat('k', 10 + turn::INT * 5) || ' ' WHEN 1 THEN repeat(text, 3) ELSE text END AS text,
  [200, 401, 402, 429, 500][turn % 5 + 1] AS status, CASE WHEN conv_id % 2 = 0 THEN 'timeout' END AS reason FROM conversations)
SELECT conv_id, turn, regexp_matches(trim(text), '^[A-Za-z0-9_-]{16,256}$') AS key_shaped, length(trim(text)) BETWEEN 1 AND 2000 AS allowed,
  CASE WHEN status = 401 THEN 'Провайдер отклонил доступ. Отправь /start и проверь ключ.' WHEN status = 402 THEN 'Провайдер не выполнил запрос: проверь баланс и доступ к модели.'
    WHEN status = 429 THEN 'Сейчас достигнут лимит запросов провайдера. Попробуй чуть позже.' WHEN reason = 'timeout' THEN 'Провайдер не успел ответить. Попробуй повторить вопрос чуть позже.'
    ELSE 'Не получилось получить ответ от API. Попробуй чуть позже; это не означает, что сведений нет в документах.' END AS message FROM c"""
)
def question_gates(spark, sf):
    c, k = table(spark, sf, "conversations"), F.col("conv_id") % 4
    key = F.concat(F.lit(" "), F.repeat(F.lit("k"), (10 + F.col("turn") * 5).cast("int")), F.lit(" "))
    c = c.withColumn("text", F.when(k == 0, key).when(k == 1, F.repeat("text", 3)).otherwise(F.col("text")))
    status = F.get(F.array(*map(F.lit, (200, 401, 402, 429, 500))), (F.col("turn") % 5).cast("int"))
    reason = F.when(F.col("conv_id") % 2 == 0, "timeout")
    return c.select("conv_id", "turn", di.key_shaped(F.col("text")).alias("key_shaped"), di.question_allowed(F.col("text")).alias("allowed"), di.failure_message(status, reason).alias("message"))


@query(
    """SELECT conv_id, turn, reason FROM (SELECT conv_id, turn, ['ok', 'abstain', 'schema_error', 'no_hits'][(conv_id + turn) % 4 + 1] AS reason FROM conversations)
WHERE reason <> 'schema_error' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8"""
)
def remembered_turns(spark, sf):
    reason = F.get(F.array(*map(F.lit, ("ok", "abstain", "schema_error", "no_hits"))), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    return di.remembered(table(spark, sf, "conversations").select("conv_id", "turn", reason.alias("reason")))


@query(
    r"""WITH n AS (SELECT conv_id, turn, text || ' ' || turn || ',5' AS text, coalesce(lag(text || ' ' || turn || ',5') OVER (PARTITION BY conv_id ORDER BY turn, text), '') AS b FROM conversations),
m AS (SELECT conv_id, turn, text AS current, CASE WHEN turn % 2 = 0 THEN text || ' ' || b ELSE b END AS produced, CASE WHEN conv_id % 2 = 0 THEN b || ' ' || text ELSE text END AS allowed FROM n),
x AS (SELECT conv_id, turn, list_transform(regexp_extract_all(current, '\d+(?:[.,]\d+)?'), lambda v: replace(v, ',', '.')) AS c,
  list_transform(regexp_extract_all(produced, '\d+(?:[.,]\d+)?'), lambda v: replace(v, ',', '.')) AS p,
  list_transform(regexp_extract_all(allowed, '\d+(?:[.,]\d+)?'), lambda v: replace(v, ',', '.')) AS a FROM m)
SELECT conv_id, turn, len(list_filter(c, lambda v: NOT list_contains(p, v))) = 0 AND len(list_filter(p, lambda v: NOT list_contains(a, v))) = 0 AS kept FROM x"""
)
def numbers_preserved(spark, sf):
    """A rewrite is the turn with the one before it, or only that; a conversation in two may use the turn's own numbers alone."""
    from pyspark.sql import Window as W

    rows = table(spark, sf, "conversations").withColumn("text", F.concat("text", F.lit(" "), F.col("turn").cast("string"), F.lit(",5")))
    rows = rows.withColumn("b", F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn", "text")), F.lit("")))
    produced = F.when(F.col("turn") % 2 == 0, F.concat_ws(" ", "text", "b")).otherwise(F.col("b"))
    allowed = F.when(F.col("conv_id") % 2 == 0, F.concat_ws(" ", "b", "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", co.numbers_kept(F.col("text"), produced, allowed).alias("kept"))


#: Letters whose capital form has several characters (ß: SS), and the one character that stands for each in SQL.
SEVERAL = "".join(c for c in map(chr, range(0x10000)) if len(c.upper()) > 1)
ONE = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in SEVERAL)


def _capitals(text):
    """Capitals with one character for each of the text's, as in SQL, so that a quote keeps its length."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.char_length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, SEVERAL, ONE))), "")


def _answers(spark, sf):
    """(answers, sources): payloads made from documents, one kind of failure for each remainder of the id by 10."""
    k = F.col("doc_id") % 10
    start = F.substring("text", 1, 60)
    quote = (
        F.when(k == 6, F.substring(start, 1, 10)).when(k == 5, "a quote that is in no text at all").when(k == 4, "short").when(k == 7, _capitals(start))
        .when(k == 8, F.concat(F.substring(start, 1, 5), F.lit(" " * 30))).otherwise(start)
    )
    own = F.col("doc_id").cast("string")
    proof = F.struct(F.when(k == 4, F.lit("none")).otherwise(own).alias("id"), quote.alias("quote"))
    claim = F.struct(F.when(k == 2, F.lit("see http://x.org")).otherwise(F.lit(" a claim")).alias("text"), F.when(k == 3, F.array()).otherwise(F.array(proof, proof)).alias("evidence"))
    abstain = F.when(k == 9, F.lit(None)).otherwise(k == 0)
    claims = F.when(k == 1, F.array()).when(F.col("doc_id") % 20 < 10, F.array(claim, claim)).otherwise(F.array(claim))
    docs = table(spark, sf, "documents")
    sources = docs.select(own.alias("id"), "text", F.col("source").alias("title"), (F.col("doc_id") % 50 + 1).alias("page"), F.concat(F.lit("https://x/"), own, F.lit("#old")).alias("url"))
    return docs.select(F.col("doc_id").alias("answer_id"), F.to_json(F.struct(abstain.alias("abstain"), claims.alias("claims"))).alias("payload")), sources


A = r"""WITH p AS (SELECT doc_id, text, source, substring(text, 1, 60) AS q, (doc_id % 10)::INT AS k FROM documents),
w AS (SELECT *, trim(regexp_replace(q, '\s+', ' ', 'g')) AS nq, trim(regexp_replace(text, '\s+', ' ', 'g')) AS nt, trim(regexp_replace(upper(q), '\s+', ' ', 'g')) AS uq FROM p),
r AS (SELECT *, CASE
  WHEN k = 0 THEN 'abstain' WHEN k IN (1, 2, 3, 6, 9) THEN 'schema_error' WHEN k = 4 THEN 'unknown_citation' WHEN k IN (5, 8) THEN 'quote_mismatch'
  WHEN length(q) NOT BETWEEN 20 AND 400 THEN 'schema_error'
  WHEN k = 7 AND (length(uq) < 20 OR NOT contains(nt, uq)) THEN 'quote_mismatch' WHEN k <> 7 AND length(nq) < 20 THEN 'quote_mismatch' ELSE 'ok' END AS reason FROM w)"""


@query(A + " SELECT doc_id AS answer_id, reason FROM r")
def answer_reasons(spark, sf):
    return co.checked_answers(*_answers(spark, sf))


@query(
    A
    + """ SELECT doc_id AS answer_id, 'Краткий вывод' || chr(10) || 'a claim [1]' ||
  CASE WHEN doc_id % 20 < 10 THEN chr(10) || chr(10) || 'Подробности' || chr(10) || 'a claim [1]' ELSE '' END || chr(10) || chr(10) || 'Источники' || chr(10) ||
  '[1] ' || source || ', PDF стр. ' || (doc_id % 50 + 1) || chr(10) || 'https://x/' || doc_id || '#page=' || (doc_id % 50 + 1) AS text, [doc_id::VARCHAR] AS cited FROM r WHERE reason = 'ok' AND source IS NOT NULL"""
)
def answer_texts(spark, sf):
    return co.rendered_answers(*_answers(spark, sf)).filter("text IS NOT NULL")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1800 SECONDS THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)
SELECT user_id, session::BIGINT AS session, CAST(min(ts) AS VARCHAR) AS start, CAST(max(ts) AS VARCHAR) AS "end", count(*) AS events FROM s GROUP BY ALL"""
)
def user_sessions(spark, sf):
    out = co.sessions(table(spark, sf, "events"), "user_id", "ts")
    return out.withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


RATE = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
a AS (SELECT user_id, i, ts FROM e WHERE i = 1
  UNION ALL SELECT user_id, i, ts FROM (SELECT e.user_id, e.i, e.ts, row_number() OVER (PARTITION BY e.user_id ORDER BY e.i) AS r
    FROM e JOIN a ON e.user_id = a.user_id AND e.i > a.i AND e.ts >= a.ts + INTERVAL 21600 SECONDS) WHERE r = 1)
SELECT e.user_id, e.event_id, a.i IS NOT NULL AS accepted FROM e LEFT JOIN a ON a.user_id = e.user_id AND a.i = e.i"""


@query(RATE)
def rate_limited(spark, sf):
    return co.rate_limited(table(spark, sf, "events"), "user_id", "ts", "event_id", 21600)


@query(
    shown(
        """WITH r AS (SELECT event_type AS reason, value AS elapsed, event_id % 10 = 0 AS technical, CASE WHEN event_id % 3 > 0 THEN (event_id % 5)::DOUBLE END AS cost FROM events)
--
SELECT reason, count(*) AS requests, count_if(technical) AS technical, median(elapsed) AS median, quantile_cont(elapsed, 0.95) AS p95, sum(cost) AS cost FROM r GROUP BY 1""",
        "median p95 cost",
    )
)
def runtime_summary(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    return told(
        co.runtime_summary(
            e.select(F.col("event_type").alias("reason"), F.col("value").alias("elapsed"), (i % 10 == 0).alias("technical"), F.when(i % 3 > 0, (i % 5).cast("double")).alias("cost"))
        )
    )


@query(
    shown(
        """WITH c AS (SELECT user_id, event_id % 50 <> 0 AS observed, event_id % 11 AS completion, CASE WHEN event_id % 40 > 0 THEN event_id % 7 END AS hit, event_id % 13 AS miss FROM events)
--
SELECT user_id, count(*) AS calls, sum(completion)::BIGINT AS completion,
  CASE WHEN count_if(NOT observed) = 0 AND count(hit) = count(*) THEN (sum(hit) * 1.0 + sum(miss) * 2.0 + sum(completion) * 3.0)::DOUBLE / 1e6 END AS cost FROM c GROUP BY 1""",
        "cost",
    )
)
def usage_cost(spark, sf):
    i = F.col("event_id")
    calls = table(spark, sf, "events").select(
        "user_id", (i % 50 != 0).alias("observed"), (i % 11).alias("completion"), F.when(i % 40 > 0, i % 7).alias("cache_hit"), (i % 13).alias("cache_miss")
    )
    return told(co.usage_cost(calls, "user_id", 1.0, 2.0, 3.0))


@query(
    shown(
        """WITH r AS (SELECT doc_id % 5 AS grp, quality, CASE WHEN quality = 0 THEN toxic END AS toxic FROM labels), l AS (UNPIVOT r ON quality, toxic INTO NAME flag VALUE value)
--
SELECT grp, flag, count(*) AS applicable, count_if(value = 1) AS positive, avg(value) AS share FROM l GROUP BY ALL""",
        "share",
    )
)
def rating_summary(spark, sf):
    rows = table(spark, sf, "labels").select((F.col("doc_id") % 5).alias("grp"), "quality", F.when(F.col("quality") == 0, F.col("toxic")).alias("toxic"))
    return told(co.rating_summary(rows, "grp", ["quality", "toxic"]))


@query(
    "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY a, event_type)::INT AS place FROM (SELECT user_id, event_type, min(event_id) AS a FROM events GROUP BY ALL)"
)
def first_occurrences(spark, sf):
    return co.first_occurrences(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id AS k FROM events)
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'union_all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)
UNION ALL SELECT 'disjoint', (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) = 0"""
)
def set_operations(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, sf, "events").select(F.col("user_id").alias("k")).distinct()
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b), "union_all": a.union(b)}
    parts = [d.agg(F.lit(n).alias("op"), F.count("*").alias("n")) for n, d in made.items()]
    parts.append(made["intersect"].agg(F.lit("disjoint").alias("op"), (F.count("*") == 0).cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    r"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, coalesce(text, '') AS rest FROM documents),
m AS (
  SELECT doc_id, r, 0 AS step, NULL::VARCHAR AS head, rest, false AS done FROM d
  UNION ALL
  SELECT doc_id, r, step + 1,
    CASE WHEN length(rest) <= 1800 THEN rest ELSE regexp_replace(substring(rest, 1, cut), '\s+$', '') END,
    CASE WHEN length(rest) <= 1800 THEN '' ELSE ltrim(substring(rest, cut + 1), chr(10) || ' ') END,
    length(rest) <= 1800
  FROM (SELECT *, CASE WHEN nl >= 900 THEN nl WHEN sp > 0 THEN sp ELSE 1800 END AS cut FROM (
    SELECT *, CASE WHEN contains(f, chr(10)) THEN length(f) - strpos(reverse(f), chr(10)) ELSE -1 END AS nl, CASE WHEN contains(f, ' ') THEN length(f) - strpos(reverse(f), ' ') ELSE -1 END AS sp
    FROM (SELECT *, substring(rest, 1, 1801) AS f FROM m WHERE NOT done))))
SELECT doc_id, (row_number() OVER (PARTITION BY r ORDER BY step) - 1)::INT AS part, head AS text FROM m WHERE step > 0 AND (head <> '' OR (done AND step = 1))"""
)
def message_parts(spark, sf):
    return co.split_messages(table(spark, sf, "documents"), "doc_id", "text")


def _stream(spark, sf):
    """The events table as a stream of finished files."""
    e = table(spark, sf, "events")
    rows = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark) -> str:
    """A new folder of the shared ones; of this machine only where driver and executors are one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not shared and spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='tidewater-')}/streams/{uuid.uuid4().hex}"


@query(RATE)
def stream_rate_limited(spark, sf):
    """One batch here, so that all events of a user are in order of time."""
    return state.collected(state.rate_limited(_stream(spark, sf), 21600), "rate", _folder(spark))


@query(
    """WITH e AS (SELECT user_id, epoch_ms(ts) AS t FROM events), m AS (SELECT max(t) - 600000 AS seen FROM e),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 1800000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g),
a AS (SELECT user_id, s, min(t) AS start_ms, max(t) AS end_ms, count(*) AS events FROM s GROUP BY ALL)
SELECT user_id, start_ms, end_ms, events FROM a, m WHERE s < (SELECT max(s) FROM a b WHERE b.user_id = a.user_id) OR end_ms + 1800000 < seen"""
)
def stream_sessions(spark, sf):
    """Sessions that a later event of the user, or the watermark, has ended."""
    return state.collected(state.sessions(_stream(spark, sf)), "sessions", _folder(spark))


@query(
    """WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS requests, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL)
SELECT CAST(start::DATE AS VARCHAR) AS start, event_type, requests, mean_value FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def stream_request_metrics(spark, sf):
    """Days that the watermark has passed."""
    out = state.collected(state.request_metrics(_stream(spark, sf)), "metrics", _folder(spark))
    return out.withColumns({"start": F.col("start").cast("date").cast("string"), "mean_value": F.round("mean_value", 6)})
