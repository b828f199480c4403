import random

import pytest

from tidewater.llm import lattice, pieces
from tidewater.session import table


def test_relational_fold(spark):
    rng = random.Random(4)
    letters = "abcé▁"
    names = ["<unk>", *"abc", *{"".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(60)}]
    model = pieces.Pieces(tuple(names), tuple([0.0, *[-rng.uniform(1, 9) for _ in names[1:]]]), (pieces.UNKNOWN, *[pieces.NORMAL] * (len(names) - 1)), False, False)
    words = ["", "é", "xé", *{"".join(rng.choice(letters + "x") for _ in range(rng.randrange(1, 14))) for _ in range(200)}]
    got = {r["word"]: r["ids"] for r in lattice.encode_words(spark.createDataFrame([(w,) for w in [*words, None]], "word string"), model).collect()}
    assert set(got) == set(words) - {""}
    for w, ids in got.items():
        assert [model.unknown if i < 0 else i for i in ids] == pieces.best_path(w, model)
    assert lattice.encode_words(spark.createDataFrame([], "word string"), model).count() == 0


def test_relational_fold_of_merges(spark, docs_words):
    """The relations give the ids of the library's words."""
    model = pieces.load()
    got = {r["word"]: [model.unknown if i < 0 else i for i in r["ids"]] for r in lattice.encode_words(docs_words, model).collect()}
    assert len(got) > 300
    for w, ids in got.items():
        want = pieces.merged(w, model)
        assert [i for i in ids if i != model.unknown] == [i for i in want if model.kinds[i] != pieces.BYTE], w


@pytest.fixture(scope="module")
def docs_words(spark):
    from pyspark.sql import functions as F

    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(20)
    return docs.select(F.explode(lattice.words_of(F.col("text"))).alias("word")).filter("xxhash64(word) % 3 = 0")
