"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import pieces, quality
from tidewater.llm.ann import nearest
from tidewater.llm.exact import exact_dedup
from tidewater.llm.langid import identify_held_out
from tidewater.llm.lines import line_report
from tidewater.llm.mixing import mix
from tidewater.llm.near import near_dedup
from tidewater.llm.passages import passage_report
from tidewater.llm.secrets import labelled_samples, secret_report, train
from tidewater.session import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"), train(labelled_samples(spark)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the labels whose crc32 of the id leaves a remainder by 5; the others can test it."""
    docs, labels = table(spark, sf_dir, "documents"), quality.graded(table(spark, sf_dir, "labels"))
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    return quality.grade(docs, quality.fit(labels.filter(remainder != 0), docs))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents"), pieces.load(), check=True)
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "round_trip")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_near_dedup": op2_near_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_mix_sources": op7_mix_sources,
        "op8_secret_scan": op8_secret_scan,
        "op9_quality": op9_quality,
        "op10_sentencepiece": op10_sentencepiece,
    }


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1 ' || coalesce(doc_id::VARCHAR, 'null') || ' ' || md5(coalesce(text, ''))) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
c AS (SELECT *, source_size * 3 AS cap, source_size * 3 / weight AS ratio FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER p, 0)::DOUBLE)
            / ((sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER p, 0)::DOUBLE) AS level
  FROM c WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT arg_min(level, ratio) AS x FROM l WHERE level <= ratio),
t AS (
  SELECT source, source_size, CASE WHEN ratio < x THEN cap::DOUBLE ELSE x * weight END AS target FROM l, x),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS full_times FROM t),
r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.full_times,
         round(b.target)::BIGINT - b.full_times * b.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (full_times * size + least(size, greatest(0, rest - before)))::BIGINT AS taken
FROM r
"""


UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Rows of (doc_id, i, word), i from 1; documents without words have none.
WORDS_SQL = r"""
d AS (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d)"""

OP2_SQL = f"""
WITH RECURSIVE {WORDS_SQL.format(text=f"translate(coalesce(text, ''), {UPPER})")},
f AS (
  SELECT doc_id, string_agg(word, ' ') OVER five AS shingle, count(*) OVER five AS n, i, max(i) OVER (PARTITION BY doc_id) AS words
  FROM x WINDOW five AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, shingle FROM f WHERE n = 5 OR (words < 5 AND i = 1)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT s.doc_id AS u, t.doc_id AS v, count(*) AS shared FROM s JOIN s t ON t.shingle = s.shingle AND t.doc_id <> s.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM b JOIN c cu ON cu.doc_id = u JOIN c cv ON cv.doc_id = v WHERE 100 * shared >= 75 * (cu.n + cv.n - shared)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.reach)
SELECT r.doc_id, coalesce(first(c.n), 0) AS n_shingles, min(reach) AS component_id, r.doc_id = min(reach) AS kept
FROM r LEFT JOIN c ON c.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP3_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {UPPER}) AS key FROM x),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(keeper <> doc_id, false) AS gone FROM k LEFT JOIN h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY 1
"""

OP6_SQL = f"""
WITH {WORDS_SQL.format(text="coalesce(text, '')")},
f AS (
  SELECT *, string_agg(word, ' ') OVER fifty AS run, count(*) OVER fifty AS n
  FROM x WINDOW fifty AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
o AS (SELECT md5(run) AS h, min(doc_id) AS owner FROM f WHERE n = 50 GROUP BY 1),
m AS (SELECT f.doc_id, i, word, (n = 50 AND owner < doc_id)::INT AS hit FROM f JOIN o ON o.h = md5(run) WHERE n = 50
      UNION ALL SELECT doc_id, i, word, 0 FROM f WHERE n < 50),
g AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM m),
t AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that DuckDB can express; its cost grows faster than the operators', so that it is for small tables."""
    return {
        "op2_near_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op7_mix_sources": OP7_SQL,
    }
