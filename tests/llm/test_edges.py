"""Repeated ids with other texts, clashing columns, extreme ids, hot rows: what the docstrings promise."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewater.llm import common, exact, lines, mixing, near, passages

SMALLEST = -(1 << 63)


def say(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def brute_passages(rows, window=50):
    """[(doc_id, n_words, n_removed, sha)] of rows that may repeat an id."""
    owner, words = {}, [(i, brute.WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1 if i is not None else 0):
            t = tuple(w[k : k + window])
            owner[t] = min(owner.get(t, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if owner[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def test_passages_of_repeated_ids(spark):
    rng = random.Random(1)
    a, b = say(rng, 120), say(rng, 300)
    rows = [(1, a), (7, a + " " + say(rng, 40)), (7, say(rng, 20)), (7, b), (9, b[: len(b) // 2]), (None, a), (None, a), (9, None), (SMALLEST, b), (7, b)]
    rows += [(20, a)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in passages.passage_report(df).collect()), key=str)
    assert got == brute_passages(rows)


def test_factors(spark):
    """Factors are copies of one place of a smaller document, as long as it goes on."""
    rng = random.Random(2)
    a, b = (say(rng, 200).split() for _ in range(2))
    rows = [(1, a), (2, b), (3, [*a[20:150], "x", *b[30:130], *a[100:170]])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    texts = dict(rows)
    found = [(r["at"], r["to"], r["ref_id"], r["ref_at"]) for r in passages.duplicate_factors(df).orderBy("at").collect()]
    for at, to, ref, ref_at in found:
        assert to - at >= 50 and texts[3][at:to] == texts[ref][ref_at : ref_at + to - at]
    assert {(0, 130, 1, 20), (131, 231, 2, 30), (231, 301, 1, 100)} == set(found)


def test_lines_of_repeated_ids(spark):
    long = ["L" * 50 + str(i) for i in range(3)]
    rows = [(i, long[0] + "\nown") for i in range(4)] + [(3, long[0] + "\nother"), (2, "\n".join(long)), (None, long[0]), (2, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["kept_sha256"], r["n_dropped"]) for r in lines.line_report(df).collect()}
    kept = lambda i, t, n: (i, hashlib.sha256(t.encode()).hexdigest(), n)
    want = {kept(i, "own", 1) for i in range(3)} | {kept(3, long[0] + "\nown", 0), kept(3, long[0] + "\nother", 0), kept(2, "\n".join(long[1:]), 1), kept(None, long[0], 0), kept(2, "short", 0)}
    assert got == want
    clash = df.selectExpr("doc_id", "text", "1 as one", "2 as twin", "3 as _id", "4 as _one", "5 as _twin", "6 as _word", "7 as _drops")
    out = lines.without_repeats(clash)
    assert out.columns == clash.columns and out.count() == len(rows)
    assert {tuple(r)[2:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7)}


def test_exact_of_the_smallest_id(spark):
    rows = [(SMALLEST, "a b"), (5, "ab"), (None, "a b"), (7, "c"), (7, "c d"), (7, "c d")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(SMALLEST, SMALLEST, 3, True), (5, SMALLEST, 3, False), (None, SMALLEST, 3, False), (7, 7, 1, True), (7, 7, 2, True)}


@pytest.mark.parametrize("words", [1 << 20, 0])
def test_filters_at_any_size(spark, monkeypatch, words):
    """Broadcast or distributed, a filter passes all repeated keys and few others; columns may have its names."""
    monkeypatch.setattr(common, "FILTER_WORDS", words)
    n = 20_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.xxhash64("id")).alias("key"), F.col("id").alias("_word"), F.lit(0).alias("_bits"))
    rows = rows.unionByName(rows.filter("_word % 100 = 1")).unionByName(spark.createDataFrame([(None, -1, 0)], "key long, _word long, _bits int"))
    some, rest = common.suspects(rows, "key", rows.count(), "test")
    assert some.columns == rest.columns == rows.columns
    assert some.count() + rest.count() == rows.count()
    sure = rows.groupBy("key").count().filter("count > 1 AND key IS NOT NULL").select("key")
    assert rest.join(sure, "key").count() == 0 and rest.filter("key IS NULL").count() == 1
    alone = some.join(sure, "key", "left_anti").count()
    assert alone <= 0.05 * n
    ids = spark.range(50).select((F.col("id") * 7).alias("gone"))
    assert common.without(rows, "_word", ids, "gone").count() == rows.join(ids, F.col("_word") == F.col("gone"), "left_anti").count()


def test_share_of_suspects_at_scale():
    """Of keys that are all different, the share with a twice-seen slot does not grow with their number."""
    import numpy as np

    for n in (100_000, 3_000_000):
        slots = np.random.default_rng(n).integers(0, 1 << 62, n) & (common.filter_bits(n) - 1)
        _, count = np.unique(slots, return_counts=True)
        assert count[count > 1].sum() <= n / common.FILTER_BITS * 1.02


def test_secrets_in_a_long_text(spark):
    """Many matches in one text take seconds; spans are those of the plain version."""
    rng = random.Random(3)
    from tidewater.llm import secrets

    hexes = " ".join("%016x" % rng.getrandbits(64) for _ in range(64_000))
    mixed = "\n".join(f"token = {'%020x' % rng.getrandbits(80)} é AKIA{'A1B2C3D4E5F6G7H8'[: 8 + i % 9]} plain_{i}" for i in range(3000))
    dump = "".join(rng.choice(secrets.LETTERS) for _ in range(300_000))
    rows = [(1, hexes), (2, mixed), (2, mixed), (None, dump), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("spans", "runs", "_text", "line", "base")})
    began = time.time()
    got = secrets.secret_report(df, secrets.train(secrets.labelled_samples(spark))).collect()
    assert time.time() - began < 60 and len(got) == len(rows)
    assert {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got} == brute.secrets(rows)
    spans = [x.split(":") for r in got if r["doc_id"] is None for x in r["spans"].split(",")]
    assert ("markov", "0", "300000") in {tuple(x) for x in spans} or any(x[0] in ("hex", "assign") for x in spans)


def near_components(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_dedup(df).collect()), key=str)


def test_near_of_repeated_ids(spark):
    """Each row is a document: two texts of one id link with their own copies."""
    rng = random.Random(4)
    a, b = say(rng, 200), say(rng, 200)
    other = lambda t: t.replace(t.split()[100], "other", 1)
    got = near_components(spark, [(1, a), (1, b), (2, other(a)), (3, other(b)), (SMALLEST, None), (8, a), (8, a)])
    assert {(i, c) for i, _, c, _ in got} == {(1, 1), (2, 1), (3, 1), (8, 1), (SMALLEST, SMALLEST)}
    assert sum(k for *_, k in got) == 3 and len(got) == 7


def test_near_in_buckets_of_many(spark, monkeypatch):
    """Families that share a bucket, compared in many small blocks: links between texts that are far from every center."""
    monkeypatch.setattr(near, "SKETCHES", 16)
    monkeypatch.setattr(near, "TEXTS", 8)
    rng = random.Random(5)
    rows = []
    for f in range(12):
        base = (say(rng, 150) + " " if f % 3 == 0 else rows[0][1][:200] + " ") + say(rng, 150)
        words = base.split()
        for _ in range(14):
            some = list(words)
            for k in rng.sample(range(len(some)), rng.randrange(1, 9)):
                some[k] = f"x{rng.randrange(999)}"
            rows.append((len(rows), " ".join(some)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_dedup(df).collect()} == brute.near(rows)


def test_near_links_found(spark):
    """Pairs from just above the threshold on: the bands and the likelihood lose none of 150 links."""
    rng = random.Random(6)
    rows, links = [], 0
    for i in range(150):
        words = say(rng, 400).split()
        some = list(words)
        for k in rng.sample(range(400), 1 + i % 12):
            some[k] = "y"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(some))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near(rows)
    links = sum(want[2 * i + 1][1] == 2 * i for i in range(150))
    assert links > 100 and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_dedup(df).collect()} == want


def test_mix_beside_any_columns(spark):
    """Columns with the operator's own names keep their values; rows that repeat an id, or have none, are spread by their texts."""
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, None, i]), say(rng, rng.randrange(1, 40)), rng.choice("ab")) for i in range(300)]
    own = ["_key", "_size", "_place", "_number", "_tie", "_part", "_time", "_p", "key", "order", "size", "row", "words", "full", "last", "time", "part"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(i) for i, c in enumerate(own)})
    plain = mixing.mixed(df.select("doc_id", "text", "source"))
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert {tuple(r)[3:] for r in out.collect()} == {tuple(range(len(own)))}
    told = lambda d: sorted(((r["doc_id"], r["text"], r["source"]) for r in d.collect()), key=str)
    assert told(out) == told(plain)
    got = mixing.mix(df).collect()
    for source in "ab":
        part = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 0.5 + 1e-9
        words = sum(len(t.split()) for _, t, s in told(out) if s == source)
        assert words == sum(r["taken"] for r in part)
