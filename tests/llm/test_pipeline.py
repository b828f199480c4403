"""The pipeline's stages against plain versions at the smallest scale, and the queries' digests."""

import hashlib

import pytest

import corpus_pipeline
from tests.llm import brute
from tidewater.llm import queries
from tidewater.llm.common import written
from tidewater.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        out.append((name, docs))
    return out


def test_stages(spark, stages):
    source = table(spark, SF, "documents")
    good, cut, apart, mixed, coded = (d for _, d in stages)
    for d in (good, cut, apart, mixed):
        assert d.columns == source.columns
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in table(spark, SF, "labels").collect()}
    assert not any(labels.get(i, (1, 0))[1] for i in kept)
    clean = [i for i, x in labels.items() if x == (1, 0)]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    after = {r["doc_id"]: r for r in cut.collect()}
    want = brute.lines(list(kept.items()))
    assert {i: hashlib.sha256(r["text"].encode()).hexdigest() for i, r in after.items()} == {i: x[2] for i, x in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    groups = brute.near([(i, r["text"]) for i, r in after.items()])
    assert {r["doc_id"] for r in apart.collect()} == {i for i, (_, c) in groups.items() if c == i}
    assert coded.count() == mixed.count() and coded.filter("NOT round_trip").count() == 0


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()


@pytest.mark.parametrize("name, plain, columns", [
    ("op2_near_dedup", brute.near, ["n_shingles", "component_id"]),
    ("op3_line_dedup", brute.lines, ["n_lines", "n_dropped", "kept_sha256"]),
    ("op6_substring_dedup", brute.passages, ["n_words", "n_removed", "kept_sha256"]),
    ("op8_secret_scan", brute.secrets, ["n_assign", "n_access", "n_hex", "base_sha256"]),
])
def test_query(spark, name, plain, columns):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in queries.queries()[name](spark, SF).collect()}
    assert got == plain(rows)


def test_stages_on_edges(spark):
    """Null ids, texts and sources, blanks, repeated rows, a long text, and columns named like the operators' own."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(40_000))
    texts = [None, "", " \n\t", "A few plain words here.", long, long + " more", "A few plain words here."]
    rows = [(None if i == 3 else i, t, "en", None if i % 2 else "s", len(t or ""), 7, 8, 9) for i, t in enumerate(texts)]
    rows += [rows[3], rows[4], rows[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key long, _word long, _row long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        before = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, docs, SF), "test-edges")
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == docs.columns
                assert {tuple(r)[5:] for r in out.collect()} <= {(7, 8, 9)}
            docs = out
        assert docs.count() >= (1 if before else 0) and (before or docs.count() == 0)
        assert docs.filter("NOT round_trip").count() == 0


def test_drop_copies_with_null_ids(spark):
    """Of each group one row stays: the smallest id, or one of the null ids where there are no others."""
    copied, alone, single = ("\n".join(f"{w}{i} and {w}{i * 7 % 50}" for i in range(60)) for w in ("a", "b", "c"))
    rows = [(9, copied), (None, copied), (4, copied), (None, copied + " more"), (None, alone), (None, alone), (None, alone), (None, single), (7, single + " more"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], (r["text"] or "")[:1]) for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(4, "a"), (None, "b"), (7, "c"), (None, ""), (2, "")], key=str)
    assert corpus_pipeline.drop_copies(spark, docs.filter("doc_id IS NULL"), SF).count() == 4


def test_drop_copies_of_repeated_ids(spark):
    """Rows of one id are documents of their own: what is not a copy stays."""
    a, b, c = ("\n".join(f"{w}{i} and {w}{i * 7 % 50}" for i in range(60)) for w in ("a", "b", "c"))
    rows = [(5, a), (5, b), (5, b), (3, a + " more"), (9, c), (9, c + " more"), (9, "x"), (9, None)]
    got = [(r["doc_id"], (r["text"] or "")[:1]) for r in corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()]
    assert sorted(got) == [(3, "a"), (5, "b"), (9, ""), (9, "c"), (9, "x")]
