"""Queries of retrieval: benchmark items ask documents, and embeddings by the same number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import retrieval as re_
from tidewater.plans.catalog import query, shown, told
from tidewater.session import table


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical(spark, sf):
    return re_.bm25_ranked(table(spark, sf, "documents"), questions(spark, sf))


def semantic(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("id")).join(v, "id").select(F.col("id").alias("query_id"), "v")
    return re_.dense_ranked(v, q)


def hybrid(spark, sf):
    return re_.fused([(lexical(spark, sf), 1.0), (semantic(spark, sf), 1.0)]).withColumn("score", F.round("score", 9))


def hits(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("page"), "text")
    return re_.diverse(hybrid(spark, sf).join(d, "id"))


L = r"""
WITH d AS (SELECT doc_id, source, lang, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents),
st AS (SELECT count(*) AS n, greatest(avg(len(coalesce(t, []))), 1) AS al FROM d),
a AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
p AS (SELECT doc_id AS id, term, count(*) AS tf, first(l) AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al)))), 6) AS score
  FROM a JOIN p USING (term) JOIN f USING (term), st GROUP BY ALL),
lx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM b WHERE score > 0 QUALIFY rank <= 30)"""
D = (
    L
    + """,
u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
s AS (SELECT q.id AS query_id, u.id, round(list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * q.v[i])), 6) AS score
  FROM u, (SELECT u.* FROM u JOIN benchmark ON item_id = u.id) q),
sm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 30),
hy AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM lx UNION ALL SELECT * FROM sm) GROUP BY ALL),
h AS (SELECT hy.*, source, lang AS page, text FROM hy JOIN d ON d.doc_id = hy.id),
h1 AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, source, page ORDER BY score DESC, id) <= 2),
h2 AS (SELECT * FROM h1 QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) <= 3),
h3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM h2 QUALIFY rank <= 6)"""
)


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) <= 380 THEN 1 ELSE ceil((len(w) - 380) / 320)::INT + 1 END)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i::INT AS chunk, len(w[i * 320 + 1:i * 320 + 380])::INT AS n_words, array_to_string(w[i * 320 + 1:i * 320 + 380], ' ') AS text FROM c"""
)
def word_chunks(spark, sf):
    return re_.chunks(table(spark, sf, "documents"), "doc_id", "text")


@query(shown(L + "\n--\nSELECT n AS documents, al AS avg_length, (SELECT count(DISTINCT term) FROM p) AS terms FROM st", "avg_length"))
def corpus_statistics(spark, sf):
    return told(re_.corpus_statistics(table(spark, sf, "documents"), "doc_id", "text"))


@query(L + " SELECT query_id, id, score, rank FROM lx")
def bm25_top(spark, sf):
    return lexical(spark, sf)


@query(D + " SELECT query_id, id, score, rank FROM sm")
def dense_top(spark, sf):
    return semantic(spark, sf)


@query(D + " SELECT query_id, id, score FROM hy")
def hybrid_fused(spark, sf):
    return hybrid(spark, sf)


@query(D + " SELECT query_id, id, source, page, score, rank FROM h3")
def diverse_hits(spark, sf):
    return hits(spark, sf).drop("text")


@query(
    D
    + """, k AS (SELECT *, 11000 - coalesce(sum(least(2300, length(text))) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM h3)
SELECT query_id, id, rank, substring(text, 1, least(2300, r)::INT) AS text FROM k WHERE r >= 200"""
)
def context_packed(spark, sf):
    return re_.packed(hits(spark, sf)).select("query_id", "id", "rank", "text")


@query(
    shown(
        D
        + """, g AS (SELECT item_id AS query_id, item_id % 2 AS grp, 'src' || (item_id % 20)::VARCHAR AS source, ['en', 'de'] AS pages FROM benchmark),
f1 AS (SELECT query_id, min(rank) FILTER (list_contains(pages, page)) AS first, true AS seen FROM g JOIN h3 USING (query_id, source) GROUP BY 1)
--
SELECT grp, count(*) AS questions, count(first) AS found, count(seen) AS all_sources, count(first) AS all_pages, avg(coalesce(1 / first, 0)) AS mrr FROM g LEFT JOIN f1 USING (query_id) GROUP BY ROLLUP (grp)""",
        "mrr",
    )
)
def retrieval_evaluation(spark, sf):
    gold = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        (F.col("item_id") % 2).alias("grp"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"),
        F.array(F.lit("en"), F.lit("de")).alias("pages"),
    )
    return told(re_.evaluated(hits(spark, sf), gold))


@query(
    """WITH l AS (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '(?is)<a\\b[^>]*?href="([^"#]+)"[^>]*>(.*?)</a>', 1))) AS l FROM pages)
SELECT page_id, len(l)::INT AS links, CASE WHEN len(l) = 1 THEN l[1] END AS link FROM l"""
)
def single_page_link(spark, sf):
    return re_.single_link(table(spark, sf, "pages"))


@query(
    D
    + """, pl AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 24),
ns AS (SELECT *, CASE WHEN query_id % 4 = 0 AND id % 10 = 0 THEN NULL ELSE length(text)::DOUBLE END AS ns FROM pl),
fb AS (SELECT *, count(*) OVER (PARTITION BY query_id) <> count(ns) OVER (PARTITION BY query_id) AS fell_back FROM ns),
sc AS (SELECT query_id, id, source, page, fell_back, CASE WHEN fell_back THEN score ELSE ns END AS score FROM fb),
s1 AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, source, page ORDER BY score DESC, id) <= 2),
s2 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) <= 3)
SELECT query_id, id, source, page, score, fell_back, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s2 QUALIFY rank <= 6"""
)
def reranked_hits(spark, sf):
    """The new score is the text's length here, unknown for some hits of every fourth query."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("page"), "text")
    pool = hybrid(spark, sf).join(d, "id")
    new = F.when((F.col("query_id") % 4 == 0) & (F.col("id") % 10 == 0), F.lit(None)).otherwise(F.char_length("text").cast("double"))
    out = re_.reranked(pool.withColumn("new_score", new).drop("text"))
    return out.select("query_id", "id", "source", "page", "score", "fell_back", "rank")


@query(
    r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages),
w AS (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM p),
c AS (SELECT page_id, w, unnest(range(CASE WHEN len(w) <= 40 THEN 1 ELSE ceil((len(w) - 40) / 30)::INT + 1 END)) AS i FROM w WHERE len(w) > 0),
k AS (SELECT page_id, i::INT AS chunk, len(w[i * 30 + 1:i * 30 + 40])::INT AS n_words, array_to_string(w[i * 30 + 1:i * 30 + 40], ' ') AS text FROM c)
SELECT p.page_id, length(p.text) < 80 AS is_weak, chunk, n_words, k.text FROM p LEFT JOIN k ON k.page_id = p.page_id AND length(k.text) >= 30"""
)
def page_parts(spark, sf):
    return re_.page_parts(table(spark, sf, "pages"), "page_id", F.regexp_replace("html", "<[^>]*>", " "), size=40, overlap=10)


@query(L + " SELECT term, df FROM f")
def document_frequencies(spark, sf):
    return re_.document_frequencies(table(spark, sf, "documents"), "doc_id", "text")


@query(
    D
    + """, hs AS (SELECT * FROM h WHERE source IN ('src3', 'src11')),
b0 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) > 1 THEN 2 WHEN source = 'src11' THEN 0 ELSE 1 END AS late FROM hs),
b1 AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY query_id, source, page ORDER BY late, score DESC, id) <= 2),
b2 AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY late, score DESC, id) <= 3)
SELECT query_id, id, source, page, score, row_number() OVER (PARTITION BY query_id ORDER BY late, score DESC, id)::INT AS rank FROM b2 QUALIFY rank <= 6"""
)
def scoped_hits(spark, sf):
    """Hits of two sources that a question names: the best of each first."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("page"))
    return re_.diverse(hybrid(spark, sf).join(d, "id"), scope=["src3", "src11"])


@query(
    D
    + """, m AS (SELECT 'bm25' AS mode, query_id, id, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM lx UNION ALL SELECT 'semantic', query_id, id, round(1.0::DOUBLE / (60 + rank), 9) FROM sm UNION ALL SELECT 'hybrid', query_id, id, score FROM hy),
mr AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, id) AS r FROM m QUALIFY r <= 6),
mg AS (SELECT mode, query_id, min(r) AS first FROM mr JOIN documents d ON d.doc_id = mr.id WHERE d.source = 'src' || (query_id % 20)::VARCHAR GROUP BY ALL)
SELECT b.mode AS mode, count(*) AS questions, count(first) AS found, round(avg(coalesce(1 / first, 0)), 6) AS mrr
FROM (SELECT mode, item_id FROM (SELECT unnest(['bm25', 'semantic', 'hybrid']) AS mode), benchmark) b LEFT JOIN mg ON mg.mode = b.mode AND mg.query_id = b.item_id GROUP BY 1"""
)
def retrieval_ablation(spark, sf):
    """The same questions in every mode, scored by the source of the first hit."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("id")).join(v, "id").select(F.col("id").alias("query_id"), "v")
    docs = table(spark, sf, "documents")
    gold = questions(spark, sf).select("query_id", F.lit(0).alias("grp"), F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("source"), F.array(F.lit("any")).alias("pages"))
    out = None
    for mode in re_.MODES:
        found = re_.search(docs, questions(spark, sf), v, asked, mode).withColumn("score", F.round("score", 9))
        hits = re_.ranked(found, 6).join(docs.select(F.col("doc_id").alias("id"), "source"), "id").withColumn("page", F.lit("any"))
        part = re_.evaluated(hits, gold).filter("grp IS NULL").select(F.lit(mode).alias("mode"), "questions", "found", F.round("mrr", 6).alias("mrr"))
        out = part if out is None else out.unionByName(part)
    return out
