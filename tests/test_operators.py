import json

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewater.functions import scores as sc
from tidewater.operators import answering, arima
from tidewater.operators import backtest as bt
from tidewater.operators import conversations as co
from tidewater.operators import dialogue as di
from tidewater.operators import grid as gr
from tidewater.operators import learners as le
from tidewater.operators import models as mo
from tidewater.operators import retrieval as re_
from tidewater.operators import series as se


def walk(spark, n=60, seed=1, future=None):
    y = 50 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.05, n)))
    if future:
        y[future:] *= 100
    return spark.createDataFrame(pd.DataFrame({"series_id": "a", "date": pd.date_range("2000-01-01", periods=n, freq="MS").date, "pos": range(n), "y": y}))


def test_forecasts_do_not_look_ahead(spark):
    key = ["model", "horizon", "origin"]
    a, b = (bt.backtest(s).filter("origin < DATE '2003-01-01'").select(*key, "y_pred").toPandas().sort_values(key, ignore_index=True) for s in (walk(spark), walk(spark, future=36)))
    assert len(a) and np.allclose(a["y_pred"], b["y_pred"])


def test_features_do_not_look_ahead(spark):
    a, b = (se.internal_features(s).filter("pos < 36").toPandas().sort_values("pos").drop(columns=["series_id", "date"]) for s in (walk(spark), walk(spark, future=36)))
    assert np.allclose(a.astype(float), b.astype(float), equal_nan=True)


def test_series_rules(spark):
    rows = spark.createDataFrame([("a", "2000-01-01", 1.0), ("a", "2000-02-01", None), ("a", "2000-02-01", 2.0), ("a", "2000-05-01", float("inf"))], "series_id string, date string, y double")
    found = {r["rule"]: r["found"] for r in se.violations(rows.withColumn("date", F.col("date").cast("date"))).collect()}
    assert found == {"repeated_date": 1, "not_positive": 2, "gap": 1}
    with pytest.raises(ValueError, match="gap"):
        se.require_valid(rows.withColumn("date", F.col("date").cast("date")))


@pytest.mark.parametrize("rows, want", [([(100.0, 1.0), (200.0, 3.0)], 175.0), ([(100.0, 0.0)], None), ([(None, 1.0)], None), ([(-20.0, 2.0), (10.0, 1.0)], -10.0)])
def test_strict_mean(spark, rows, want):
    assert spark.createDataFrame(rows, "p double, w double").agg(sc.strict_mean(F.col("p"), F.col("w"))).first()[0] == want


def test_partial_scope(spark):
    df = spark.createDataFrame([(100.0, 1.0), (200.0, 3.0), (None, 1000.0)], "p double, w double")
    got = df.agg(sc.known_mean(F.col("p"), F.col("w")), F.avg("p"), sc.strict_sum(F.col("w")), sc.strict_sum(F.col("p"))).first()
    assert tuple(got) == (175.0, 150.0, 1004.0, None)


def test_pinball_sides(spark):
    y, q, t = F.lit(10.0), F.lit(9.0), F.lit(0.05)
    got = spark.range(1).select(sc.pinball(y, q, t), sc.pinball_mirrored(y, q, t)).first()
    assert got[0] == pytest.approx(0.05) and got[1] == pytest.approx(0.95)


def test_ensemble_needs_all_members(spark):
    rows = [("a", m, 1, "2000-01-01", "2000-02-01", 1.0, p) for m, p in (("w", 10.0), ("x", 20.0), ("y", 30.0), ("z", 40.0))]
    schema = "series_id string, model string, horizon int, origin string, target string, y_true double, y_pred double"
    e = bt.ensembles(spark.createDataFrame(rows, schema), ["w", "x", "y", "z"])
    assert e.filter("model = 'ensemble'").first()["y_pred"] == 25
    assert bt.ensembles(spark.createDataFrame(rows[:3], schema), ["w", "x", "y", "z"]).isEmpty()


def test_selection_ignores_the_test_period(spark):
    rows = [("s", "validation", "a", 1, 1.0, 1.0), ("s", "validation", "b", 1, 2.0, 2.0), ("s", "test", "a", 1, 100.0, 1.0), ("s", "test", "b", 1, 0.0, 0.0)]
    t = spark.createDataFrame(rows, "series_id string, period string, model string, horizon int, mae double, rmse double")
    assert bt.selected(t.filter("period = 'validation'")).first()["model"] == "a"


def test_isotonic():
    assert np.allclose(mo.isotonic(np.array([1.0, 3.0, 2.0, 2.0, 5.0])), [1, 7 / 3, 7 / 3, 7 / 3, 5])
    x = np.random.default_rng(0).normal(size=50)
    assert (np.diff(mo.isotonic(x)) >= -1e-12).all() and mo.isotonic(x).mean() == pytest.approx(x.mean())


def test_bootstrap(spark):
    rows = [("a", 12, i, -2.0) for i in range(60)] + [("b", 21, i, 1.0) for i in range(30)] + [("c", 1, i, float(i % 7)) for i in range(200)]
    got = {r["series_id"]: r for r in mo.bootstrap_intervals(spark.createDataFrame(rows, "series_id string, horizon int, origin int, difference double")).collect()}
    assert (got["a"]["mean"], got["a"]["low"], got["a"]["high"]) == (-2, -2, -2)
    assert got["b"]["low"] is None and got["b"]["n"] == 30
    assert got["c"]["low"] == pytest.approx(got["c"]["mean"] - 1.96 * 2 / 200**0.5, abs=0.06) and got["c"]["high"] > got["c"]["mean"]


def test_ridge_shrinks():
    rng = np.random.default_rng(0)
    x, e = rng.normal(size=(200, 2)), rng.normal(0, 0.01, 200)
    y = 3 + x @ [1.0, -2.0] + e
    assert np.allclose(mo.ridge(x, y, 1e-9)(x), y, atol=0.05)
    assert np.abs(mo.ridge(x, y, 1e6)(x) - y.mean()).max() < 0.1


def test_autoregression_follows_a_line():
    y = np.exp(0.01 * np.arange(60) + 1) * (1 + 0.001 * np.sin(np.arange(60)))
    assert np.allclose(mo.autoregression(y, 1, 5), np.exp(0.01 * np.arange(60, 65) + 1), rtol=0.01)
    assert 1 <= mo.chosen_lags(y) <= 4
    assert np.allclose(mo.holt(np.arange(1.0, 40), 3), [40, 41, 42])


def test_quantile_regression():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (4000, 1))
    y = 2 * x[:, 0] + rng.uniform(0, 1, 4000)
    assert mo.quantile_regression(x, y, 0.9) == pytest.approx([0.9, 2.0], abs=0.06)


def test_grid_totals(spark):
    keys = [("2026-09-%02d" % d, h, s, float(i + 1), 100.0 * (i + 1)) for d in (1, 2) for h in range(24) for i, s in enumerate("abcdefg")]
    rows = spark.createDataFrame(keys, "date string, hour int, system string, consumption double, price double").withColumn("generation", F.lit(10.0))
    total = gr.totals(rows).filter("level = 7").first()
    assert (total["generation"], total["consumption"], total["price"]) == (3360, 1344, 500)
    hour = gr.totals(rows.withColumn("price", F.when(F.col("system") != "a", F.col("price")))).filter("date = '2026-09-01' AND hour = 0").first()
    assert hour["price"] is None and hour["prices"] == 6


def greedy(rows, top, page_cap, source_cap):
    out, pages, sources = [], {}, {}
    for i, source, page, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if pages.get((source, page), 0) < page_cap and sources.get(source, 0) < source_cap and len(out) < top:
            out.append(i)
            pages[source, page] = pages.get((source, page), 0) + 1
            sources[source] = sources.get(source, 0) + 1
    return out


def test_diversity_equals_a_greedy_walk(spark):
    rng = np.random.default_rng(3)
    rows = [(q, i, f"s{rng.integers(3)}", f"p{rng.integers(4)}", float(rng.integers(6))) for q in range(20) for i in range(24)]
    got = re_.diverse(spark.createDataFrame(rows, "query_id long, id long, source string, page string, score double")).collect()
    for q in range(20):
        mine = [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == greedy([r[1:] for r in rows if r[0] == q], 6, 2, 3)


def test_requested_sources_come_first(spark):
    rows = [(1, i, "b", f"p{i}", 10.0 - i) for i in range(8)] + [(1, 9, "a", "p", 0.1), (1, 10, "c", "p", 99.0)]
    df = spark.createDataFrame(rows, "query_id long, id long, source string, page string, score double")
    order = lambda **k: [r["id"] for r in re_.diverse(df, **k).orderBy("rank").collect()]
    assert order(scope=["b", "a"]) == [9, 0, 1, 2] and order(scope=["b"]) == [0, 1, 2, 3, 4, 5] and order() == [10, 0, 1, 2, 9]


def test_query_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0])]
    got = re_.valid_queries(spark.createDataFrame(rows, "query_id long, v array<double>"), 2).collect()
    assert {r["query_id"]: r["fault"] for r in got} == {1: None, 2: "size", 3: "size", 4: "no_length", 5: "not_finite"}


def test_ranks_of_blocks_equal_those_of_rows(spark):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{int(v)}" for v in rng.zipf(1.5, n) % 50)
    docs = spark.createDataFrame([(i, word(30)) for i in range(300)] + [(300, None), (301, "")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, word(4)) for q in range(20)] + [(99, "nothing")], "query_id long, text string")
    told = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    rows = told(re_.ranked(re_.bm25(docs, asked).withColumn("score", F.round("score", 6)), 7, 0.0))
    assert told(re_.bm25_ranked(docs, asked, 7)) == rows and told(re_.bm25_ranked(docs, asked, 7, most=3)) == rows
    assert re_.bm25_ranked(docs, asked.filter("query_id < 0")).count() == 0
    assert told(re_.bm25_ranked(docs, asked, 7, scope=F.col("doc_id") < 50)) == told(re_.ranked(re_.bm25(docs, asked, scope=F.col("doc_id") < 50).withColumn("score", F.round("score", 6)), 7, 0.0))


def test_alternate_questions(spark):
    docs = spark.createDataFrame([(1, "power demand"), (2, "спрос"), (3, "other")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "спрос", "demand"), (8, "other", None)], "query_id long, text string, alternate string")
    assert {(r["query_id"], r["id"]) for r in re_.bm25(docs, asked).collect()} == {(7, 1), (7, 2), (8, 3)}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.0, 2.0])], "query_id long, v array<double>")
    for rows in (re_.dense(v, q), re_.dense_ranked(v, q)):
        assert {r["id"]: round(r["score"], 3) for r in rows.collect()} == {1: 1.0, 2: 1.0, 3: 0.707}
    assert re_.dense_ranked(v, q.filter("query_id < 0")).count() == 0
    with pytest.raises(ValueError):
        re_.search(docs, asked, mode="semantic")


def test_dense_blocks_equal_broadcast(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "id long, v array<double>")
    q = v.filter("id < 5").withColumnRenamed("id", "query_id")
    a, b = (sorted((r[0], r[1], round(r[2], 9)) for r in re_.dense(v, q, most, 10).collect()) for most in (100, 2))
    assert a == b and len(a) == 150


def test_chunks_overlap(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(700)))), (2, "a b"), (3, " "), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["chunk"]): r["text"].split() for r in re_.chunks(df, "doc_id", "text").collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)} and got[1, 1][0] == "320" and got[1, 1][-1] == "699"


def test_answer_checks(spark):
    quote = "the price rose in two of three years"
    proof = {"id": "s", "quote": quote}
    good = {"abstain": False, "claims": [{"text": " It rose.", "evidence": [proof, proof]}, {"text": "More.", "evidence": [{"id": "t", "quote": "eﬃciency of the second text"}, proof]}]}
    one = lambda text, *evidence: json.dumps({"abstain": False, "claims": [{"text": text, "evidence": list(evidence)}]})
    cases = {
        1: (json.dumps(good), "ok"),
        2: ("not json", "schema_error"),
        3: (json.dumps({"abstain": True, "claims": []}), "abstain"),
        4: (json.dumps({"abstain": False, "claims": []}), "schema_error"),
        5: (one("see [1]"), "schema_error"),
        6: (one("x", {"id": "s", "quote": "short"}), "schema_error"),
        7: (one("x", {"id": "u", "quote": "short"}), "unknown_citation"),
        8: (one("x", {"id": "s", "quote": quote + "!"}), "quote_mismatch"),
        9: (json.dumps({**good, "abstain": None}), "schema_error"),
        10: (one("x", {"id": "s", "quote": quote.upper()}), "quote_mismatch"),
        11: (one("x", {"id": "s", "quote": "rose" + " " * 30}), "quote_mismatch"),
    }
    answers = spark.createDataFrame([(i, p) for i, (p, _) in cases.items()], "answer_id long, payload string")
    texts = [("s", "Indeed the\u00a0price  rose in two\nof three ye-\nars."), ("t", "The efficiency of the second text, soft\u00adly.")]
    sources = spark.createDataFrame([(i, t, f"T{i}", 3, f"https://x/{i}#old") for i, t in texts], "id string, text string, title string, page int, url string")
    assert {r[0]: r[1] for r in co.checked_answers(answers, sources).collect()} == {i: f for i, (_, f) in cases.items()}
    told = co.rendered_answers(answers, sources).collect()
    assert [r["answer_id"] for r in told] == [1] and told[0]["cited"] == ["s", "t"]
    want = "Краткий вывод\nIt rose. [1]\n\nПодробности\nMore. [2] [1]\n\nИсточники\n[1] Ts, PDF стр. 3\nhttps://x/s#page=3\n\n[2] Tt, PDF стр. 3\nhttps://x/t#page=3"
    assert told[0]["text"] == want


def test_quotes_in_capitals_keep_their_length(spark, tmp_path):
    # All of the kind quoted in capitals. 19 characters with ß would be 20 with SS; capitals with letters that have no single capital are quoted as they are.
    texts = ["Einü ßbe der erä le.", "Einü ßbe der erä l.", "ßßßßßßßßßßßßßß", "ŉ ALL OF THIS IN CAPITALS", "ΑΛΛΑ ᾼ ΚΑΙ ΑΛΛΑ ΠΟΛΛΑ", "DIE STRAẞE NACH NEUSTADT", "DIE STRAßE NACH NEUSTADT", "DIE STRASSE NACH NEUSTADT", "😀 ALL OF THIS IN CAPITALS"]
    path = str(tmp_path / "documents.parquet")
    rows = spark.createDataFrame([(10 * i + 7, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    for name in ("answer_reasons", "answer_texts"):
        want = sorted(con.sql(entry.oracle_sql()[name]).fetchall())
        assert sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()) == want, name
    mismatch, schema = "quote_mismatch", "schema_error"
    reasons = [r[1] for r in sorted(con.sql(entry.oracle_sql()["answer_reasons"]).fetchall())]
    assert reasons == [mismatch, schema, schema, "ok", "ok", "ok", mismatch, "ok", "ok"]


def test_normal_texts(spark):
    pairs = {"ﬁrst\u00a0 line": "first line", "electri-\n  city": "electricity", "1-\n2": "1- 2", "a \u2013 b \u2212 c": "a - b - c", "so\u00adft": "soft", "Case": "Case"}
    df = spark.createDataFrame([(k,) for k in pairs], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", co.normal(F.col("t")).alias("n")).collect()} == pairs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dialogue_rules(spark):
    aliases = {"plan_2024": ["plan 2024", "план"], "review": ["review"]}
    rows = [(1, 1, "План 2024: спрос в 2022 и 2024"), (1, 2, "А почему это в 2023?"), (1, 3, "Сколько электростанций построено"), (2, 1, "а почему это?"), (3, 1, "Review 2021"), (3, 2, "почему так")]
    got = {(r["conv_id"], r["turn"]): r for r in di.resolved_questions(spark.createDataFrame(rows, "conv_id long, turn long, question string"), aliases).collect()}
    assert got[1, 2]["resolved"] == "План 2024: спрос в и 2024\nУточнение: А почему это в 2023?\nИсточники: plan_2024"
    assert not got[1, 3]["leans"] and not got[2, 1]["leans"] and got[3, 2]["resolved"] == "Review 2021\nУточнение: почему так\nИсточники: review"
    assert one(spark, di.neutral(F.lit("Почему вырос спрос, а цена снизилась?"))) == "изменение спрос, а цена изменение"
    assert one(spark, di.neutral(F.lit("Как вырос спрос?"))) == "Как вырос спрос?"
    assert one(spark, di.hints(F.lit("Мировой спрос на электроэнергию вырос на 4,3% в ЕС"))) == "global electricity demand change Europe 4.3%"
    none = F.array().cast("array<string>")
    asks = lambda t: one(spark, di.asks_about_citations(F.lit(t), none))
    assert asks("Какие источники у первого ответа?") and asks("откуда это") and asks("ссылки?") and not asks("Какой спрос на электроэнергию в Китае в 2024 году был")
    assert not one(spark, di.asks_about_citations(F.lit("ссылка на план"), F.array(F.lit("plan"))))
    assert one(spark, di.key_shaped(F.lit(" sk-0123456789abcdef "))) and not one(spark, di.key_shaped(F.lit("short")))
    assert [one(spark, di.question_allowed(F.lit(t))) for t in (" ", "x", "x" * 2001)] == [False, True, False]


def test_citation_answers(spark):
    source = "sources array<struct<title:string,page:int,url:string>>"
    turns = spark.createDataFrame([(1, 1, [("A", 3, "https://a#b"), ("B", None, "")]), (1, 2, [])], f"conv_id long, turn int, {source}")
    asked = [(1, 1, "источники первого ответа"), (2, 1, "откуда это?"), (3, 1, "источники третьего ответа"), (4, 1, "какой спрос")]
    got = {r["question_id"]: (r["outcome"], r["text"]) for r in di.citation_answers(spark.createDataFrame(asked, "question_id long, conv_id long, text string"), turns, {}).collect()}
    assert got == {1: ("sources", "[1] A, PDF стр. 3\nhttps://a#page=3\n\n[2] B"), 2: ("no_sources", None), 3: ("no_answer", None)}


def test_entrance():
    door = di.Entrance(capacity=2, ttl_seconds=300)
    assert door.admit("a", 0) and door.admit("b", 1) and not door.admit("c", 300) and door.admit("a", 300)
    assert door.admit("c", 301.5) and not door.holds("b", 301.5) and door.holds("a", 600)


def test_sessions_end_at_the_limit(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:29:59"), (1, "2024-01-01 00:59:59")], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["events"] for r in co.sessions(df, "user_id", "ts").collect()) == [1, 2]


def test_stream_sessions_are_exact_to_the_millisecond(spark, tmp_path):
    times = [
        (1, "2024-01-01 00:00:00.123499"), (2, "2024-01-01 00:00:00.123500"), (3, "2024-01-01 00:00:00.999999"),
        # Under 30 minutes apart, but 30 minutes to the nearest millisecond; and as near to the watermark, which is of 20:00:00.001.
        (4, "2024-01-01 00:00:00.000400"), (4, "2024-01-01 00:29:59.999900"), (5, "2024-01-01 19:20:00"), (6, "2024-01-01 19:20:00.000500"), (7, "2024-01-01 20:00:00.000600"),
    ]
    path = str(tmp_path / "events.parquet")
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {', '.join(f'({u}::BIGINT, TIMESTAMP {t!r})' for u, t in times)}) t(user_id, ts)) TO '{path}'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    want = sorted(con.sql(entry.oracle_sql()["stream_sessions"]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()["stream_sessions"](spark, str(tmp_path)).collect())
    assert got == want and [w[0] for w in want] == [1, 2, 3, 4, 4, 5] and (2, 1704067200124, 1704067200124, 1) in got


def test_only_accepted_requests_move_the_clock(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate((0, 3, 6, 9, 11))], "user_id long, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["accepted"] for r in co.rate_limited(df, "user_id", "ts", "event_id", 5).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_split_message():
    parts = co.split_message("word " * 1000, 100)
    assert all(0 < len(p) <= 100 for p in parts) and " ".join(parts).split() == ["word"] * 1000
    assert co.split_message("x" * 250, 100) == ["x" * 100, "x" * 100, "x" * 50] and co.split_message("", 100) == [""]
    assert [len(p) for p in co.split_message("Hi\n" + "x" * 2500, 1800)] == [1800, 703]
    assert co.split_message("  a\n" + "b" * 99, 100)[0] == "a\n" + "b" * 98 and co.split_message(" a ", 100) == [" a "]
    assert co.split_message("a" * 60 + "\n" + "b " * 40, 100) == ["a" * 60, "b " * 39 + "b "]


@pytest.mark.parametrize("most", [1, 2, 7, 100])
def test_split_messages_without_python_workers(spark, most):
    r = np.random.default_rng(most)
    signs = list("ab \n\r\t\u00a0\x1cé😀")
    texts = [None, "", " ", " " * 250, "x" * 250, "\n" * most + "x", "x" * most + " \n", "a😀" * 120, "😀" * most, "x" * most + "\n \u00a0", "x" * (most + 1) + " \t "]
    texts += ["".join(r.choice(signs, r.integers(0, 6 * most), p=q / q.sum())) for q in r.random((150, len(signs))) ** 3]
    df = co.split_messages(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", most)
    assert "MapInPandas" not in df._jdf.queryExecution().toString() and dict(df.dtypes) == {"k": "bigint", "part": "int", "text": "string"}
    want = [(k, i, p) for k, t in enumerate(texts) for i, p in enumerate(co.split_message(t or "", most))]
    assert sorted(tuple(r) for r in df.collect()) == want


def test_arima_recovers_a_process():
    e = np.random.default_rng(0).normal(size=800)
    w = np.zeros(800)
    for t in range(1, 800):
        w[t] = 0.6 * w[t - 1] + e[t] + 0.4 * e[t - 1]
    found = arima.fit(w + 5, (1, 0, 1))
    assert found.ar[0] == pytest.approx(0.6, abs=0.08) and found.ma[0] == pytest.approx(0.4, abs=0.08) and found.mean == pytest.approx(5, abs=0.4)
    assert found.stable and found.invertible and arima.diagnostics(found)["lb_p"] > 0.01
    # Forecasts go to the mean by powers of the coefficient; those of a differenced series go on from its end.
    ahead = found.forecast(40)
    assert ahead[2] - found.mean == pytest.approx((ahead[1] - found.mean) * found.ar[0]) and ahead[-1] == pytest.approx(found.mean, abs=1e-3)
    walk = np.cumsum(e) + 50
    assert arima.fit(walk, (0, 1, 0)).forecast(3) == pytest.approx([walk[-1]] * 3)
    assert arima.chosen(walk, arima.orders()).order[1] == 1 and arima.fit(walk[:4], (2, 1, 2)) is None
    assert arima.selected_arma(walk[:60], 5).shape == arima.selected_arima(walk[:60], 5).shape == (5,)


def test_unit_root_tests():
    e = np.random.default_rng(1).normal(size=400)
    assert arima.dickey_fuller(np.cumsum(e))[1] > 0.05 > arima.dickey_fuller(e)[1]
    assert arima.kpss(np.cumsum(e))[1] == 0.01 and arima.kpss(e)[1] > 0.05
    assert [arima.chi_square_tail(x, k) for x, k in ((21.026, 12), (3.841, 1), (11.07, 5))] == pytest.approx([0.05] * 3, abs=1e-4)
    assert arima.arch_lm(e)[1] > 0.01 > arima.arch_lm(e * np.exp(np.sin(np.arange(400) / 20) * 2))[1]


def test_expanding_models_do_not_look_ahead(spark):
    make = lambda future: arima.expanding(walk(spark, 60, future=future), {"AR1": arima.classic_models()["AR1"]}, [1, 3], 40, 2).filter("origin < '2004-06-01'")
    a, b = (sorted((r["origin"], r["horizon"], r["y_pred"]) for r in make(f).collect()) for f in (None, 54))
    assert a == b and len(a) == 14


def test_boosting():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (600, 3))
    y = np.where(x[:, 0] > 0.2, 3.0, 0.0) + x[:, 1] + 0.1 * r.normal(size=600)
    new = r.uniform(-0.9, 0.9, (200, 3))
    made = le.boosted(x, y)(new)
    assert np.abs(made - np.where(new[:, 0] > 0.2, 3.0, 0.0) - new[:, 1]).mean() < 0.15
    noise = r.uniform(0, 1, 600)
    low, high = (le.boosted(x, noise, tau, rounds=60)(new).mean() for tau in (0.1, 0.9))
    assert low == pytest.approx(0.1, abs=0.07) and high == pytest.approx(0.9, abs=0.07)
    assert (le.boosted(np.ones((20, 2)), np.arange(20.0))(np.ones((1, 2))) == 9.5).all()


def test_networks():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 4))
    y = np.stack([x[:, 0] + 0.5 * x[:, 1], np.tanh(x[:, 2])], axis=1)
    made = le.network(x, y, rounds=800, patience=100)(x[:50])
    assert np.abs(made - y[:50]).mean() < 0.2
    levels = [0.1, 0.5, 0.9]
    q = le.network(x, y + r.normal(size=y.shape), levels, rounds=400)(x)
    assert q.shape == (400, 2, 3) and (np.diff(q, axis=2) >= 0).all()
    assert (le.network(x, y, seed=4, rounds=5)(x) == le.network(x, y, seed=4, rounds=5)(x)).all()


def test_source_grid(spark):
    systems = spark.createDataFrame([(1, "a"), (2, "b")], "id long, system string")
    stamp = "2026-09-01T00:00:00+03:00"
    volumes = spark.createDataFrame([(1, stamp, 0, 10.0, 1.0), (1, stamp, 1, 10.0, 1.0), (2, stamp, 0, 5.0, None)], "id long, stamp string, hour int, generation double, consumption double")
    prices = spark.createDataFrame([("2026-09-01", 1, 0, 7.0), ("2026-09-01", 2, 0, None), ("2026-09-01", 2, 5, 3.0)], "date string, id long, hour int, price double")
    make = lambda v=volumes, p=prices: gr.source_grid(v, p, systems, "2026-09-01", "2026-09-30")
    got = {(r["system"], r["hour"]): (r["price"], r["price_reason"]) for r in make().collect()}
    assert got == {("a", 0): (7.0, None), ("a", 1): (None, "no price row"), ("b", 0): (None, "price is null")}
    bad = [volumes.replace(stamp, "2026-09-01T00:00:00+00:00"), volumes.replace(stamp, "2026-10-01T00:00:00+03:00"), volumes.withColumn("hour", F.lit(24)), volumes.unionByName(volumes), volumes.withColumn("id", F.lit(9))]
    for v in bad:
        with pytest.raises(ValueError):
            make(v)


def test_complete_reports(spark):
    grid = gr.expected("2026-09-01", "2026-09-01", spark.createDataFrame([("a",)], "system string"))
    rows = grid.select("*", F.lit("actual").alias("status"), F.lit(1.0).alias("generation"), F.lit(1.0).alias("consumption"), F.lit(2.0).alias("price"))
    assert gr.require_complete(gr.quality(rows, grid)).first()["complete"]
    some = rows.filter("hour > 0").withColumn("price", F.when(F.col("hour") > 1, F.col("price")))
    assert sorted(r["kind"] for r in gr.lacking_keys(some, grid).collect()) == ["missing", "null_price"]
    with pytest.raises(ValueError, match="1 missing, 1 unpublished_prices"):
        gr.require_complete(gr.quality(some, grid))
    assert gr.require_complete(gr.quality(some, grid), allow_partial=True).first()["missing"] == 1
    with pytest.raises(ValueError):
        gr.expected("2026-09-02", "2026-09-01", spark.createDataFrame([("a",)], "system string"))


def test_strict_mean_refuses_bad_numbers(spark):
    for row in ((1.0, -1.0), (float("nan"), 1.0), (1.0, float("inf"))):
        with pytest.raises(Exception, match="weight is below 0"):
            spark.createDataFrame([row, (2.0, 3.0)], "p double, w double").agg(sc.strict_mean(F.col("p"), F.col("w"))).collect()


def test_months(spark):
    day = lambda t: F.lit(t).cast("date")
    assert [str(x) for x in one(spark, se.previous_month(day("2026-01-15")))] == ["2025-12-01", "2025-12-31"]
    assert str(one(spark, se.named_month(F.lit("2024-02")))["end"]) == "2024-02-29"
    assert [one(spark, se.named_month(F.lit(t))) for t in ("2026-13", "2026-9", "2026-09-01")] == [None] * 3
    assert one(spark, se.month_difference(day("2026-01-31"), day("2024-11-01"))) == 14 and one(spark, se.days_in_month(day("2023-02-10"))) == 28
    got = [str(one(spark, se.parsed_date(F.lit(t)))) for t in ("03/04/2020", "13.01.2020", "01.2020", "2020.05", "2020-01-02 03:04:05", "12/31/2020", "x")]
    assert got == ["2020-04-03", "2020-01-13", "2020-01-01", "2020-05-01", "2020-01-02", "2020-12-31", "None"]


def test_extended_summary_needs_the_naive_model(spark):
    rows = spark.createDataFrame([("s", "test", "m", 1, "2020-01-01", 1.0, 2.0)], "series_id string, period string, model string, horizon int, origin string, y_true double, y_pred double")
    with pytest.raises(Exception, match="no naive model"):
        bt.extended_summary(rows).collect()
    assert [bt.level_name(t) for t in (0.05, 0.29, 0.95)] == ["q05", "q29", "q95"]


def test_models_as_functions(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], "id long, text string")
    got = {r["id"]: r["v"] for r in re_.embedded(rows, "id", "text", lambda texts: [[3.0, 4.0 if t == "passage: ab" else 0.0] for t in texts], batch=1).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[3] == [1.0, 0.0] and 2 not in got
    hits = spark.createDataFrame([(1, 5, "aa", "x"), (1, 6, "b", "y")], "query_id long, id long, text string, source string")
    asked = spark.createDataFrame([(1, "q", "alternative", ["y"])], "query_id long, text string, alternate string, sources array<string>")
    score = lambda pairs: [float(len(a) * 10 + len(b)) for a, b in pairs]
    assert {r["id"]: r["new_score"] for r in re_.scored_pairs(hits, asked, score).collect()} == {5: 12.0, 6: 111.0}
    assert {r["new_score"] for r in re_.scored_pairs(hits, asked, lambda pairs: 1 / 0).collect()} == {None}


def test_synthetic_grid(spark):
    rows = gr.synthetic(spark, "2026-09-01", 30, list("abcdefg"))
    total = gr.totals(rows).filter("level = 7").first()
    assert (total["n"], total["generation"], total["consumption"], total["price"]) == (5040, 50400, 20160, 500)
    shown = gr.displayed(rows.filter("hour = 0"), {"status": "Status"}, {"status": {"actual": "published"}}, 3)
    assert shown.count() == 3 and shown.first()["Status"] == "published"


def test_partial_autocorrelations():
    e = np.random.default_rng(2).normal(size=3000)
    w = np.zeros(3000)
    for t in range(1, 3000):
        w[t] = 0.7 * w[t - 1] + e[t]
    acf, pacf = arima.autocorrelations(w, 5)
    assert acf[:3] == pytest.approx([0.7, 0.49, 0.343], abs=0.06) and pacf[0] == acf[0] and np.abs(pacf[1:]).max() < 0.06


def test_quantile_autoregression(spark):
    got = mo.quantile_autoregression(walk(spark, 200), 1, [0.1, 0.5, 0.9]).orderBy("tau").collect()
    last = walk(spark, 200).orderBy("pos").collect()[-1]["y"]
    assert [r["tau"] for r in got] == [0.1, 0.5, 0.9] and got[0]["forecast"] < last * 1.02 and got[2]["forecast"] > last * 0.98


def test_links_of_pages(spark):
    html = '<a href="/x.PDF?v=1">Full</a> <a class="b" href="/y.pdf"><b>Download PDF</b></a> <a href="/z.html">z</a>'
    pages = spark.createDataFrame([(1, html), (2, '<a href="/q.pdf">q</a><a href="/q.pdf">again</a>'), (3, "none")], "page_id long, html string")
    told = lambda **k: {r["page_id"]: (r["links"], r["link"]) for r in re_.single_link(pages, **k).collect()}
    assert told(suffix=".pdf") == {1: (2, None), 2: (1, "/q.pdf"), 3: (0, None)}
    assert told(suffix=".pdf", preferred="download pdf") == {1: (1, "/y.pdf"), 2: (1, "/q.pdf"), 3: (0, None)}


def test_evaluation_of_all_evidence(spark):
    gold = spark.createDataFrame([(1, "g", "a", [1]), (1, "g", "b", [2]), (2, "g", "a", [9])], "query_id long, grp string, source string, pages array<int>")
    hits = spark.createDataFrame([(1, 1, "b", 5), (1, 2, "a", 1), (2, 1, "a", 1)], "query_id long, rank int, source string, page int")
    got = re_.evaluated(hits, gold).filter("grp = 'g'").first()
    assert (got["questions"], got["found"], got["all_sources"], got["all_pages"], got["mrr"]) == (2, 1, 2, 0, 0.25)


def test_answers_of_a_model(spark, tmp_path):
    quote = "the price rose in two of three years"
    hits = spark.createDataFrame([(i, 1, f"s{i}", f"Indeed {quote}.", "T", 2, "https://x") for i in (1, 2, 3, 5)], "answer_id long, rank int, id string, text string, title string, page int, url string")
    questions = spark.createDataFrame([(1, "good"), (2, "mended"), (3, "never"), (4, "no hits"), (5, "fails")], "answer_id long, question string")

    def complete(question, evidence, reason):
        if question == "fails":
            raise OSError("a key that must not be told")
        good = question == "good" or (question == "mended" and reason == "unknown_citation")
        name = evidence[0][0] if good else "s1x"
        return json.dumps({"abstain": False, "claims": [{"text": "It rose.", "evidence": [{"id": name, "quote": quote}]}]})

    def store(df):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    got = {r["answer_id"]: (r["reason"], r["calls"], r["text"] is not None) for r in answering.answered(questions, hits, complete, store).collect()}
    assert got == {1: ("ok", 1, True), 2: ("ok", 2, True), 3: ("unknown_citation", 2, False), 4: ("no_hits", 0, False), 5: ("technical_failure", 1, False)}
