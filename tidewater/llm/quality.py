"""Quality classifier: ordinal cumulative-link regression over hashed text features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import tokens as T
from tidewater.llm.common import written

#: Hashed features; the last SHARES * BINS are shares of a document in bins.
FEATURES = 1 << 18
SHARES, BINS = 5, 8
#: Rated documents that the model is fitted on, about, chosen by a hash of the id; all, if there are fewer.
FIT_DOCS = 8000
#: A hashed feature of fewer fitted documents has no weight.
LEAST_DOCS = 4
#: Least P(highest grade) of a kept document. Fitting gives all grades one total weight, so that this is low on purpose.
LEAST_TAIL = 0.25
ROUNDS, RATE, SHRINK = 300, 0.3, 2e-4
#: Fitted documents whose features are held as numbers at a time.
PART = 1024

LETTERS = T.FOLDED.copy()
LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 0
#: Shape classes of bytes: capital, other letter, digit, and every other sign for itself.
SHAPES = np.arange(256, dtype=np.uint16) + 4
SHAPES[65:91], SHAPES[97:123], SHAPES[128:], SHAPES[48:58] = 1, 2, 2, 3


def shapes(w: T.Words) -> np.ndarray:
    """A hash of each word's shape: the classes of its bytes, runs of one class as one."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    kind = SHAPES[w.data[(T.EXACT != 0)[w.data]]]
    word = np.repeat(np.arange(len(w.starts), dtype=np.int32), w.ends - w.starts)
    new = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (word[1:] != word[:-1])]))
    kind, word = kind[new].astype(np.uint64), word[new]
    count = np.bincount(word, minlength=len(w.starts))
    begin = np.cumsum(count) - count
    place = np.arange(len(word)) - begin[word]
    return T.mix(np.add.reduceat(kind * T.stream(int(count.max()), 31)[place], begin))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their rows, by row: words of letters, lower-cased; shapes of words; a word said twice
    in a row; and shares of repeated, distinct and shaped words, capitals and signs, in bins."""
    rows = len(offsets) - 1
    plain, w = T.words(data, offsets, LETTERS), T.words(data, offsets)
    said, shape = w.hashes(T.FOLDED), shapes(w)
    hashed = np.uint64(FEATURES - SHARES * BINS - 1)
    twice = np.flatnonzero((said[1:] == said[:-1]) & (w.row[1:] == w.row[:-1])) if len(said) else np.zeros(0, np.int64)
    count = np.maximum(np.diff(w.first), 1)
    # Distinct words of a row: sorted hashes with the row's number in the high bits.
    pair = np.sort(((w.row.astype(np.uint64) << np.uint64(40)) | (said >> np.uint64(24))).view(np.int64))
    pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] >> 40 if len(said) else np.zeros(0, np.int64)

    def told(classes: np.ndarray) -> np.ndarray:
        """How many bytes of each row are in the classes."""
        count = np.concatenate([[0], np.cumsum(classes[data], dtype=np.int32)])
        return count[offsets[1:]] - count[offsets[:-1]]

    signs, capitals, letters, spaces = told(SHAPES > 3), told(SHAPES == 1), told(SHAPES < 3), told(T.EXACT == 0)
    solid = np.maximum(np.diff(offsets) - spaces, 1)
    odd = np.bincount(w.row, weights=USUAL[np.minimum(np.searchsorted(USUAL, shape), len(USUAL) - 1)] != shape, minlength=rows) if len(said) else np.zeros(rows)
    shares = np.stack(
        [
            np.bincount(w.row[twice], minlength=rows) / count,
            np.bincount(pair, minlength=rows) / count,
            odd / count,
            capitals / np.maximum(letters, 1),
            (signs - spaces) / solid,
        ]
    )
    # Finer near 0, where most documents are.
    bins = np.clip(np.floor(np.sqrt(np.clip(shares, 0, 1)) * BINS), 0, BINS - 1).astype(np.int64)
    at = FEATURES - SHARES * BINS
    ids = [
        (plain.hashes(LETTERS) % hashed).astype(np.int64),
        (T.mix(shape + np.uint64(1)) % hashed).astype(np.int64),
        np.full(len(twice), at - 1),
        *[at + k * BINS + bins[k] for k in range(SHARES)],
    ]
    owner = np.concatenate([plain.row, w.row, w.row[twice], *[np.arange(rows)] * SHARES])
    every = np.sort(owner * FEATURES + np.concatenate(ids))
    every = every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every
    return every % FEATURES, every // FEATURES


def _usual() -> np.ndarray:
    sample = [b"a", b"A", b"Aa", b"a.", b"a,", b"Aa.", b"Aa,", b"a?", b"a!", b"1", b"1.", b"a'a", b"a-a", b"a;", b"a:", b"A."]
    data = np.frombuffer(b" ".join(sample), np.uint8)
    return np.sort(shapes(T.words(data, np.array([0, len(data)]))))


#: Shapes of words in ordinary prose.
USUAL = _usual()


@dataclass
class Model:
    weights: np.ndarray  # of features, shared by all grades
    thresholds: np.ndarray  # between grades, rising
    grades: list[int]

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade above each threshold), by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit_arrays(ids: np.ndarray, rows: np.ndarray, grade: np.ndarray, grades: list[int]) -> Model:
    """Maximum likelihood of P(y <= k) = 1 / (1 + exp(score - threshold_k)), score = sum of weights, by Adam
    with soft thresholds that keep most weights 0; every grade has the same total weight in the likelihood."""
    n, steps = len(grade), len(grades) - 1
    seen = np.bincount(ids, minlength=FEATURES)
    keep = (seen >= LEAST_DOCS)[ids]
    ids, rows = ids[keep].astype(np.int32), rows[keep].astype(np.int32)
    rank = np.searchsorted(grades, grade)
    balance = (n / (len(grades) * np.bincount(rank, minlength=len(grades))))[rank]
    cut = np.searchsorted(rows, np.arange(n + 1))
    # A part of the rows at a time, so that the driver holds little beside the features.
    parts = [slice(i, min(n, i + PART)) for i in range(0, n, PART)]
    w = np.zeros(FEATURES)
    low = np.linspace(-1, 1, steps) if steps > 1 else np.zeros(steps)
    m, v = np.zeros(FEATURES + steps), np.zeros(FEATURES + steps)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for t in range(1, ROUNDS + 1 if steps else 0):
        g = np.zeros(FEATURES + steps)
        for part in parts:
            some, k = slice(cut[part.start], cut[part.stop]), rank[part]
            score = np.bincount(rows[some] - part.start, weights=w[ids[some]], minlength=len(k))
            upper = np.where(k < steps, sigmoid(low[np.minimum(k, steps - 1)] - score), 1.0)
            under = np.where(k > 0, sigmoid(low[np.maximum(k - 1, 0)] - score), 0.0)
            p = np.maximum(upper - under, 1e-9)
            a, b = upper * (1 - upper) / p * balance[part] / n, under * (1 - under) / p * balance[part] / n
            pull = a - b  # of the negative log-likelihood by the score
            g[:FEATURES] += np.bincount(ids[some], weights=pull[rows[some] - part.start], minlength=FEATURES)
            g[FEATURES:] -= np.bincount(np.minimum(k, steps - 1), weights=np.where(k < steps, a, 0), minlength=steps)
            g[FEATURES:] += np.bincount(np.maximum(k - 1, 0), weights=np.where(k > 0, b, 0), minlength=steps)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = RATE / np.sqrt(t)
        scale = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-4)
        step = scale * m / (1 - 0.9**t)
        w -= step[:FEATURES]
        w = np.sign(w) * np.maximum(np.abs(w) - scale[:FEATURES] * SHRINK, 0)
        low = np.maximum.accumulate(low - step[FEATURES:] + np.arange(steps) * 1e-9)
    return Model(w.astype(np.float32), low, grades)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in T.chunks(batch.column("_text")):
            ids, rows = features(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(last - first + 1)), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("grade").slice(first, last - first), lists], ["grade", "ids"])


def fit(rated: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> Model:
    """The model from rated (id, grade int) and the texts of docs. Features of about fit_docs rated documents,
    chosen by a hash of the id, reach the driver.

    An id with several grades has the lowest; of an id with several texts the one with the least hash is read. Null
    ids and grades teach nothing, a null text is an empty one. Without rated documents the model has the one grade 0.
    """
    rated = rated.select(F.col(id_col).cast("long").alias("_id"), F.col("grade").cast("int").alias("grade")).filter("_id IS NOT NULL AND grade IS NOT NULL")
    rated = written(rated.groupBy("_id").agg(F.min("grade").alias("grade")), "quality-rated")
    share = min(1.0, fit_docs / max(1, rated.count()))
    few = rated.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id")
    got = text.groupBy("_id", "grade").agg(F.min(F.struct(F.xxhash64("_text").alias("hash"), "_text")).alias("best"))
    got = got.orderBy("_id").select(F.col("best._text").alias("_text"), "grade")
    got = got.mapInArrow(_featured, "grade int, ids array<int>").toArrow()
    grade = got.column("grade").to_numpy()
    lists = got.column("ids").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    count = np.diff(lists.offsets.to_numpy()) if len(grade) else np.zeros(0, np.int64)
    ids = lists.flatten().to_numpy() if len(grade) else np.zeros(0, np.int64)
    if not len(grade):
        return Model(np.zeros(FEATURES, np.float32), np.zeros(0), [0])
    return fit_arrays(ids, np.repeat(np.arange(len(grade)), count), grade, sorted(set(grade.tolist())))


def _scored(shared) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        grades = np.array(model.grades, float)
        for batch in batches:
            expected, tails, picked = [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.int64)]
            for first, last, data, offsets in T.chunks(batch.column("_text")):
                ids, rows = features(data, offsets)
                score = np.bincount(rows, weights=model.weights[ids], minlength=last - first)
                above = model.above(score)
                edge = np.ones((last - first, 1))
                chance = np.concatenate([edge, above], axis=1) - np.concatenate([above, 0 * edge], axis=1)
                expected.append(chance @ grades)
                tails.append(above[:, -1] if above.shape[1] else edge[:, 0])
                picked.append(grades[chance.argmax(1)].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, map(np.concatenate, (expected, tails, picked)))], ["doc_id", "expected_grade", "tail", "grade"]
            )

    return step


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_tail: float = LEAST_TAIL) -> DataFrame:
    """One row per row of docs: doc_id, expected_grade, tail = P(highest grade), the likeliest grade, kept = tail >= least_tail.

    Whole texts of any length are read. Null and empty texts have only the features of shares 0. Null ids and repeated rows
    keep their places; of equally likely grades the lowest is told; without rated documents every text gets the one grade 0 and
    tail 1. Other columns are not read. Empty tables give no rows. No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_scored(shared), "doc_id long, expected_grade double, tail double, grade long")
    return out.withColumn("kept", F.col("tail") >= least_tail)


def good(docs: DataFrame, model: Model, text_col: str = "text", least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of docs, all columns, that grade() keeps: tails of just least_tail stay. Null and empty texts are judged as texts
    without words, repeated rows alike; null ids and any column names are left as they are. Empty tables give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for first, last, data, offsets in T.chunks(batch.column(text_col)):
                ids, rows = features(data, offsets)
                above = shared.value.above(np.bincount(rows, weights=shared.value.weights[ids], minlength=last - first))
                keep.append(above[:, -1] >= least_tail if above.shape[1] else np.ones(last - first, bool))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(step, docs.schema)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of labels (quality, toxic): 0 toxic, 1 of low quality, 2 good; null if a label is missing."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2).alias("grade"))
