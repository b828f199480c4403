"""Lexical, dense and hybrid retrieval as relations: chunks, postings, ranks, fusion, caps, context, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The tokens, the constants of BM25 and of rank fusion, and how long each ranked list is.
TOKEN = r"[\p{L}\p{N}_]+"
K1, B = 1.5, 0.75
RANK_BASE, LISTED = 60, 30
MODES = ("bm25", "semantic", "hybrid")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 380, overlap: int = 60) -> DataFrame:
    """doc_id, chunk (from 0), n_words, text: overlapping runs of words; the last run ends with the text."""
    words = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("_w")).filter(F.size("_w") > 0)
    step = size - overlap
    many = F.when(F.size("_w") <= size, 1).otherwise(F.ceil((F.size("_w") - size) / step) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.slice(F.col("_w"), i * step + 1, F.lit(size)))
    return rows.select("doc_id", F.posexplode(cut).alias("chunk", "_c")).select("doc_id", "chunk", F.size("_c").alias("n_words"), F.array_join("_c", " ").alias("text"))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf, len."""
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("_t"))
    return rows.select("id", F.size("_t").alias("len"), F.explode("_t").alias("term")).groupBy("id", "term").agg(
        F.count("*").alias("tf"), F.first("len").alias("len")
    )


def corpus_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: documents, mean length (1 at least), distinct terms."""
    rows = docs.select(F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("_t"))
    sizes = rows.agg(F.count("*").alias("documents"), F.greatest(F.avg(F.size("_t")), F.lit(1.0)).alias("avg_length"))
    return sizes.crossJoin(rows.select(F.explode("_t").alias("term")).distinct().agg(F.count("*").alias("terms")))


def document_frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, df: in how many documents each term occurs."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query_id", scope: Column | None = None) -> DataFrame:
    """query_id, id, score of every document that shares a term with a query (query_id, text, and alternate, if there is such a
    column: the same question in other words, whose terms count too).

    Postings are cut to query terms before they are counted; statistics are of all documents, also if a scope
    (a condition on docs) says which ones may be found.
    """
    hits, asked = _postings(docs, queries, id_col, text_col, query_col, scope)
    return hits.join(asked, "term").groupBy("query_id", "id").agg(F.sum("w").alias("score"))


def _postings(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_col: str, scope: Column | None) -> tuple[DataFrame, DataFrame]:
    """(id, term, w: the term's part of the score) of documents that may be found, and (query_id, term)."""
    text = F.concat_ws(" ", "text", "alternate") if "alternate" in queries.columns else F.col("text")
    asked = queries.select(F.col(query_col).alias("query_id"), F.explode(F.array_distinct(tokens(text))).alias("term"))
    rows = docs.select(F.col(id_col).alias("id"), (scope if scope is not None else F.lit(True)).alias("_in"), tokens(F.col(text_col)).alias("_t"))
    stats = rows.agg(F.count("*").alias("documents"), F.greatest(F.avg(F.coalesce(F.when(F.col("_t").isNotNull(), F.size("_t")), F.lit(0))), F.lit(1.0)).alias("avg_length"))
    terms = rows.select("id", "_in", F.size("_t").alias("len"), F.explode("_t").alias("term"))
    terms = terms.join(asked.select("term").distinct(), "term", "left_semi")
    post = terms.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"), F.first("_in").alias("_in"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_length")))
    hits = post.filter("_in").join(df, "term").crossJoin(F.broadcast(stats))
    return hits.select("id", "term", (idf * weight).alias("w")), asked


def bm25_ranked(
    docs: DataFrame, queries: DataFrame, top: int = LISTED, digits: int = 6, most: int = 10_000, id_col: str = "doc_id", text_col: str = "text",
    query_col: str = "query_id", scope: Column | None = None,
) -> DataFrame:
    """ranked(bm25(...)) above 0 with scores rounded to some digits, for up to `most` queries with whole numbers as ids: the postings of a document meet, and are
    scored for all queries in blocks of documents, and a task keeps the `top` of each query. So a common word costs its postings and no row for each pair of
    query and document."""
    hits, asked = _postings(docs, queries, id_col, text_col, query_col, scope)
    if queries.limit(most + 1).count() > most:
        return ranked(bm25(docs, queries, id_col, text_col, query_col, scope).withColumn("score", F.round("score", digits)), top, 0.0)
    table = asked.distinct().toPandas()
    names = np.unique(table["query_id"].to_numpy()) if len(table) else np.zeros(0, np.int64)
    terms = {t: i for i, t in enumerate(sorted(set(table["term"])))}
    line = np.array([terms[t] for t in table["term"]], np.int64)
    order = np.argsort(line, kind="stable")
    whose = np.searchsorted(names, table["query_id"].to_numpy())[order] if len(table) else line
    edge = np.searchsorted(line[order], np.arange(len(terms) + 1))
    shared = docs.sparkSession.sparkContext.broadcast((names, terms, whose, edge))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, whose, edge = shared.value
        value, known = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)
        block = max(1, (1 << 22) // max(1, len(names)))
        rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def scored(last: bool) -> None:
            nonlocal value, known, rest
            if not rest:
                return
            ids, term, w = (np.concatenate(c) for c in zip(*rest, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            # A document may go on in the next batch.
            whole = len(starts) if last else len(starts) - 1
            for at in range(0, whole, block):
                to = min(whole, at + block)
                part = slice(starts[at], starts[to] if to < len(starts) else len(ids))
                t, doc = term[part], np.searchsorted(starts[at:to], np.arange(part.start, part.stop), "right") - 1
                count = edge[t + 1] - edge[t]
                inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                cell = whose[np.repeat(edge[t], count) + inside] * (to - at) + np.repeat(doc, count)
                score = np.bincount(cell, weights=np.repeat(w[part], count), minlength=len(names) * (to - at)).reshape(len(names), to - at)
                value = np.concatenate([value, np.round(score, digits)], axis=1)
                known = np.concatenate([known, np.broadcast_to(ids[starts[at:to]], score.shape)], axis=1)
                keep = np.lexsort((known, -value), axis=1)[:, :top]
                value, known = np.take_along_axis(value, keep, 1), np.take_along_axis(known, keep, 1)
            left = slice(starts[whole] if whole < len(starts) else len(ids), None)
            rest = [(ids[left], term[left], w[left])]

        for batch in batches:
            if batch.num_rows:
                term = np.array([terms[t] for t in batch.column("term").to_pylist()], np.int64)
                rest.append((batch.column("id").to_numpy(), term, batch.column("w").to_numpy()))
                scored(False)
        scored(True)
        row, column = np.nonzero(value > 0)
        yield pa.RecordBatch.from_arrays([pa.array(names[row], pa.int64()), pa.array(known[row, column], pa.int64()), pa.array(value[row, column], pa.float64())], ["query_id", "id", "score"])

    rows = hits.select(F.col("id").cast("long").alias("id"), "term", "w").repartition("id").sortWithinPartitions("id")
    return ranked(rows.mapInArrow(step, "query_id long, id long, score double"), top, 0.0)


def valid_queries(queries: DataFrame, dim: int) -> DataFrame:
    """queries (query_id, v, ...) with fault: size, not_finite or no_length for vectors that cannot be asked, else null."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fault = F.when(F.coalesce(F.size("v") != dim, F.lit(True)), "size").when(~finite, "not_finite").when(length < 1e-12, "no_length")
    return queries.withColumn("fault", fault)


def dense(vectors: DataFrame, queries: DataFrame, most: int = 10_000, block_rows: int = 100_000) -> DataFrame:
    """query_id, id, score: the dot product of unit vectors of every (id, v) with every query (query_id, v); of a query with several
    vectors (the question and its alternate) the largest.

    Up to `most` queries are broadcast; more are dealt to blocks of the vectors by an equi-join.
    """
    unit = lambda v: F.transform(v, lambda x: x.cast("double") / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))))
    left = vectors.select("id", unit(F.col("v")).alias("_v"))
    right = queries.groupBy("query_id").agg(F.collect_list(unit(F.col("v"))).alias("_q"))
    if queries.limit(most + 1).count() <= most:
        both = left.crossJoin(F.broadcast(right))
    else:
        blocks = max(1, vectors.count() // block_rows)
        left = left.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        both = left.join(right.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))), "_b")
    dot = lambda q: F.aggregate(F.zip_with("_v", q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return both.select("query_id", "id", F.array_max(F.transform("_q", dot)).alias("score"))


def dense_ranked(vectors: DataFrame, queries: DataFrame, top: int = LISTED, digits: int = 6, most: int = 10_000) -> DataFrame:
    """ranked(dense(...)) with scores rounded to some digits, for up to `most` query vectors: blocks of vectors meet all queries as one matrix product,
    and a task keeps the `top` of each query, so that what is shuffled grows with tasks and queries and not with their product by vectors."""
    asked = queries.select("query_id", F.col("v").cast("array<double>").alias("v")).orderBy("query_id").limit(most + 1).toPandas()
    if len(asked) > most:
        return ranked(dense(vectors, queries, most).withColumn("score", F.round("score", digits)), top)
    if not len(asked):
        return ranked(vectors.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0), top)
    q = np.array(asked["v"].to_list(), float)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, first = np.unique(asked["query_id"].to_numpy(), return_index=True)
    shared = vectors.sparkSession.sparkContext.broadcast((q, first, ids))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, starts, names = shared.value
        value, known = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.array(part.column("v").to_pylist(), float)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                score = np.round(np.maximum.reduceat(unit @ x.T, starts, axis=0), digits)
                value = np.concatenate([value, score], axis=1)
                known = np.concatenate([known, np.broadcast_to(part.column("id").to_numpy(), score.shape)], axis=1)
                keep = np.lexsort((known, -value), axis=1)[:, :top]
                value, known = np.take_along_axis(value, keep, 1), np.take_along_axis(known, keep, 1)
        n = value.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(known.ravel()), pa.array(value.ravel())], ["query_id", "id", "score"])

    rows = vectors.select(F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v"))
    return ranked(rows.mapInArrow(step, "query_id long, id long, score double"), top)


def search(docs: DataFrame, questions: DataFrame, vectors: DataFrame | None = None, asked: DataFrame | None = None, mode: str = "hybrid", lexical_weight: float = 1.0, scope: Column | None = None) -> DataFrame:
    """query_id, id, score by rank fusion: of documents (doc_id, text) for questions (query_id, text) in mode bm25, of vectors (id, v) for their
    vectors asked (query_id, v) in mode semantic, of both in mode hybrid. Lexical ranks need a score above 0 and weigh
    lexical_weight beside vectors; semantic ranks have no least score."""
    if mode not in MODES or not 0 <= lexical_weight <= 1:
        raise ValueError(f"mode is one of {', '.join(MODES)}, and lexical_weight from 0 to 1")
    if mode != "bm25" and (vectors is None or asked is None):
        raise ValueError(f"mode {mode} needs vectors")
    lists = []
    if mode != "semantic":
        lists.append((bm25_ranked(docs, questions, scope=scope), lexical_weight if mode == "hybrid" else 1.0))
    if mode != "bm25":
        allowed = vectors if scope is None else vectors.join(docs.filter(scope).select(F.col("doc_id").alias("id")), "id", "left_semi")
        lists.append((dense_ranked(allowed, asked), 1.0))
    return fused(lists)


def ranked(scores: DataFrame, top: int, least: float | None = None) -> DataFrame:
    """scores with rank (from 1) by score, then id; of the first `top`, and only above `least`."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rows = scores if least is None else scores.filter(F.col("score") > least)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def fused(lists: list[tuple[DataFrame, float]]) -> DataFrame:
    """Reciprocal rank fusion of ranked lists with weights."""
    parts = [r.select("query_id", "id", (F.lit(w) / (RANK_BASE + F.col("rank"))).alias("_s")) for r, w in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query_id", "id").agg(F.sum("_s").alias("score"))


def diverse(hits: DataFrame, top: int = 6, page_cap: int = 2, source_cap: int | None = None, scope: list[str] | None = None) -> DataFrame:
    """The first `top` hits (query_id, id, source, page, score) with caps for pages and sources: pages lie within
    sources, so three ranks in a row give what a greedy walk gives.

    With a scope only hits of its sources are taken. One source alone may fill all places; of several each has its best hit
    in front, in order of the sources' names.
    """
    wanted = sorted(set(scope or []))
    source_cap = source_cap or (top if len(wanted) == 1 else max(2, (top + 1) // 2))
    rows = hits.filter(F.col("source").isin(wanted)) if wanted else hits
    late = F.lit(len(wanted))
    if len(wanted) > 1:
        best = F.row_number().over(W.partitionBy("query_id", "source").orderBy(F.desc("score"), "id")) == 1
        late = F.when(best, F.array_position(F.array(*map(F.lit, wanted)), F.col("source")) - 1).otherwise(len(wanted))
    rows = rows.withColumn("_late", late)
    order = ["_late", F.desc("score"), "id"]
    rows = rows.withColumn("_p", F.row_number().over(W.partitionBy("query_id", "source", "page").orderBy(*order))).filter(F.col("_p") <= page_cap)
    rows = rows.withColumn("_s", F.row_number().over(W.partitionBy("query_id", "source").orderBy(*order))).filter(F.col("_s") <= source_cap)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= top)
    return rows.drop("_late", "_p", "_s")


def packed(hits: DataFrame, per_hit: int = 2300, total: int = 11000, least: int = 200) -> DataFrame:
    """Hits (query_id, rank, text) cut to a budget of characters, until less than `least` is left."""
    taken = F.least(F.lit(per_hit), F.char_length("text"))
    before = F.sum(taken).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1))
    rows = hits.withColumn("_left", F.lit(total) - F.coalesce(before, F.lit(0))).filter(F.col("_left") >= least)
    return rows.withColumn("text", F.substring("text", F.lit(1), F.least(F.lit(per_hit), F.col("_left")).cast("int"))).drop("_left")


def evaluated(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """By group and over all: questions, those with a right hit, with hits of all sources and with right hits of all evidence, and the mean reciprocal rank
    of the first right hit. gold has a row (query_id, grp, source, pages) for each piece of evidence; a hit (query_id, rank, source, page)
    is right on one of the pages."""
    proof = gold.select("query_id", "grp", "source", "pages", F.monotonically_increasing_id().alias("_g"))
    met = proof.join(hits.select("query_id", "source", "rank", "page"), ["query_id", "source"], "left")
    rank = F.when(F.array_contains("pages", F.col("page")), F.col("rank"))
    one = met.groupBy("query_id", "grp", "_g").agg(F.min(rank).alias("_r"), (F.count("rank") > 0).alias("_s"))
    asked = one.groupBy("query_id", "grp").agg(F.min("_r").alias("first"), F.bool_and("_s").alias("_s"), (F.count("_r") == F.count("*")).alias("_p"))
    return asked.rollup("grp").agg(
        F.count("*").alias("questions"),
        F.count("first").alias("found"),
        F.count_if("_s").alias("all_sources"),
        F.count_if("_p").alias("all_pages"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def single_link(pages: DataFrame, suffix: str = "", preferred: str | None = None) -> DataFrame:
    """page_id, links, link: the distinct targets of a page's anchors whose path ends with suffix, in any case, and the one if it is unique. If
    anchors have the preferred words in their text, only theirs count."""
    anchor = r'(?is)<a\b[^>]*?href="([^"#]+)"[^>]*>(.*?)</a>'
    targets, texts = F.regexp_extract_all("html", F.lit(anchor), F.lit(1)), F.regexp_extract_all("html", F.lit(anchor), F.lit(2))
    every = F.arrays_zip(targets.alias("url"), F.transform(texts, lambda t: F.lower(F.regexp_replace(t, "<[^>]*>", " "))).alias("label"))
    rows = pages.select("page_id", every.alias("_a"))
    fits = F.filter("_a", lambda a: F.endswith(F.lower(F.substring_index(a["url"], "?", 1)), F.lit(suffix.lower())))
    rows = rows.withColumn("_a", fits)
    if preferred:
        best = F.filter("_a", lambda a: F.contains(a["label"], F.lit(preferred.lower())))
        rows = rows.withColumn("_a", F.when(F.size(best) > 0, best).otherwise(F.col("_a")))
    rows = rows.withColumn("_l", F.array_sort(F.array_distinct(F.transform("_a", lambda a: a["url"]))))
    return rows.select("page_id", F.size("_l").alias("links"), F.when(F.size("_l") == 1, F.element_at("_l", 1)).alias("link"))


def reranked(hits: DataFrame, scores: DataFrame | None = None, top: int = 6, pool: int = 24, **caps) -> DataFrame:
    """The best `pool` hits of each query in the order of new scores (query_id, id, new_score; or a column of the hits), capped like diverse().

    A query with a score that is missing, NaN or infinite for any hit of its pool keeps its own order.
    """
    w = W.partitionBy("query_id")
    rows = hits.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "id"))).filter(F.col("_r") <= max(pool, top)).drop("_r")
    rows = rows if scores is None else rows.join(scores, ["query_id", "id"], "left")
    new = F.col("new_score")
    bad = new.isNull() | F.isnan(new) | (F.abs(new) == float("inf"))
    rows = rows.withColumn("fell_back", F.max(bad.cast("int")).over(w) == 1)
    rows = rows.withColumns({"first_score": F.col("score"), "score": F.when(F.col("fell_back"), F.col("score")).otherwise(new)})
    return diverse(rows.drop("new_score"), top, **caps)


def page_parts(pages: DataFrame, id_col: str, text: Column, weak: int = 80, least: int = 30, size: int = 380, overlap: int = 60) -> DataFrame:
    """page_id, is_weak and the parts of each page's text with white space collapsed; weak pages have fewer than
    `weak` characters, and parts of fewer than `least` are left out."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    rows = pages.select(F.col(id_col).alias("doc_id"), clean.alias("text"))
    parts = chunks(rows, "doc_id", "text", size, overlap).filter(F.char_length("text") >= least)
    flags = rows.select("doc_id", (F.char_length("text") < weak).alias("is_weak"))
    return flags.join(parts, "doc_id", "left").withColumnRenamed("doc_id", "page_id")


def require_strong(parts: DataFrame, most_weak: float = 0.35) -> DataFrame:
    """parts, or ValueError if too many of the pages are weak."""
    seen = parts.select("page_id", "is_weak").distinct().agg(F.avg(F.col("is_weak").cast("double"))).first()[0]
    if seen is not None and seen > most_weak:
        raise ValueError(f"{seen:.0%} of the pages are weak")
    return parts


# What embedding models of passages and questions expect before a text.
PASSAGE, QUESTION = "passage: ", "query: "


def embedded(rows: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], prefix: str = PASSAGE, batch: int = 256) -> DataFrame:
    """key and v, unit vectors of the texts by a model's function, which gets so many prefixed texts at a time in the workers. ValueError for a vector
    that is not finite or has no length; null texts are left out."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                x = np.asarray(embed([prefix + t for t in some.column("t").to_pylist()]), float)
                length = np.linalg.norm(x, axis=1, keepdims=True)
                if not np.isfinite(x).all() or (length < 1e-12).any():
                    raise ValueError("a vector is not finite or has no length")
                yield pa.RecordBatch.from_arrays([some.column("k"), pa.array((x / length).astype(np.float32).tolist(), pa.list_(pa.float32()))], ["k", "v"])

    few = rows.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return few.mapInArrow(step, f"k {few.schema['k'].dataType.simpleString()}, v array<float>").withColumnRenamed("k", key)


def scored_pairs(hits: DataFrame, questions: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]], batch: int = 32) -> DataFrame:
    """query_id, id, new_score of hits (query_id, id, text, source) by a cross-encoder's function of (question, text) pairs in the workers. questions has
    (query_id, text) and may have alternate, which is asked of sources in its sources column; a function that fails gives null scores."""
    asked = questions.withColumnRenamed("text", "_ask")
    ask = F.col("_ask")
    if {"alternate", "sources"} <= set(questions.columns):
        ask = F.when(F.array_contains("sources", F.col("source")) & F.col("alternate").isNotNull(), F.col("alternate")).otherwise(ask)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            pairs, out = list(zip(part.column("ask").to_pylist(), part.column("text").to_pylist(), strict=True)), []
            for at in range(0, len(pairs), batch):
                try:
                    out += [float(v) for v in score(pairs[at : at + batch])]
                except Exception:  # a model may fail in any way; reranked() then keeps the order that hits had
                    out += [None] * len(pairs[at : at + batch])
            yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("id"), pa.array(out, pa.float64())], ["query_id", "id", "new_score"])

    rows = hits.join(asked, "query_id").select("query_id", "id", ask.alias("ask"), "text")
    return rows.mapInArrow(step, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("query_id", "id")) + ", new_score double")
