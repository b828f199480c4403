"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import tokens as T

DIMENSIONS = 4096
WORDS = DIMENSIONS // 64
#: Documents of each language that profiles are learned from, about; all, if there are fewer.
FIT_DOCS = 3000
#: Languages at most, which bounds the prototypes.
MOST_LANGUAGES = 1000
UNKNOWN = "und"
#: Bits of a code point in a trigram's key, and trigrams whose products a worker keeps.
POINT, KEPT = 21, 1 << 18


_LETTERS = np.full(0x110000, -1, np.int32)


def folded_letters(points: np.ndarray) -> np.ndarray:
    """Of every code point its lower-case letter, or 0 for those that are none; each is looked up once in a process."""
    found = _LETTERS[points]
    if len(found) and found.min() < 0:
        for i in np.unique(points[found < 0]).tolist():
            _LETTERS[i] = ord(chr(i).lower()[0]) if chr(i).isalpha() else 0
        found = _LETTERS[points]
    return found


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The random vector of each letter (or gap, 0) by its code point: +1 and -1 as bits of 64-bit words."""
    place = np.arange(WORDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    return T.mix(T.mix(points.astype(np.uint64)[:, None] * T.ODD + np.uint64(23)) + place)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Trigram vectors, as rows of 1 and 0 for +1 and -1: the letters' vectors, permuted (rolled) by two, one and no
    words, and multiplied, which is the exclusive or of their bits."""
    mask = (1 << POINT) - 1
    parts = [letter_vectors(grams >> shift & mask) for shift in (2 * POINT, POINT, 0)]
    bits = np.roll(parts[0], 2, axis=1) ^ np.roll(parts[1], 1, axis=1) ^ parts[2]
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams around every letter of the rows, and their rows; runs of other characters are one gap."""
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != starts[-1]:  # not valid UTF-8; read row by row
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    code = np.zeros(len(points) + n + 1, np.int64)
    place = np.arange(len(points)) + row + 1
    code[place] = folded_letters(points)
    owner = np.zeros(len(code), np.int64)
    owner[place] = row
    keep = (code != 0) | (np.concatenate([[1], code[:-1]]) != 0)
    code, owner = code[keep], owner[keep]
    middle = np.flatnonzero(code[1:-1]) + 1
    return np.stack([code[middle - 1], code[middle], code[middle + 1]]), owner[middle]


def counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first, last, the trigrams that occur (their code points as one number), and the matrix of counts by row
    and trigram."""
    codes, rows = trigrams(data, offsets)
    letters = np.flatnonzero(np.bincount(np.append(codes[1], 0)))
    number = np.zeros(int(letters[-1]) + 1, np.int64)
    number[letters] = np.arange(len(letters))
    k = len(letters)
    keys = (number[codes[0]] * k + number[codes[1]]) * k + number[codes[2]] if codes.shape[1] else np.zeros(0, np.int64)
    if k**3 <= 1 << 22:  # of few letters, a table of all trigrams
        known = np.flatnonzero(np.bincount(keys, minlength=k**3))
        index = np.zeros(k**3, np.int64)
        index[known] = np.arange(len(known))
        column = index[keys]
    else:
        known, column = np.unique(keys, return_inverse=True)
    grams = letters[known // k**2] << 2 * POINT | letters[known // k % k] << POINT | letters[known % k]
    n, width = len(offsets) - 1, max(1, len(known))
    step = max(1, (1 << 22) // width)
    for first in range(0, n, step):
        last = min(n, first + step)
        part = slice(*np.searchsorted(rows, [first, last]))
        flat = (rows[part] - first) * width + column[part]
        yield first, last, grams, np.bincount(flat, minlength=(last - first) * width).reshape(last - first, width)[:, : len(known)]


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each language, the sum over a task's documents of their trigrams' vectors, each document's counts at unit length."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, _, data, offsets in T.chunks(batch.column("_text")):
            for a, b, grams, counts in counted(data, offsets):
                length = np.sqrt((counts.astype(float) ** 2).sum(1, keepdims=True))
                unit = counts / np.maximum(length, 1)
                mine = langs[first + a : first + b]
                names = sorted(set(mine))
                weight = np.array([unit[mine == lang].sum(0) for lang in names])
                for i in range(0, len(grams), 2048):
                    part = weight[:, i : i + 2048]
                    sums = 2 * (part @ gram_vectors(grams[i : i + 2048])) - part.sum(1, keepdims=True)
                    for lang, v in zip(names, sums, strict=True):
                        total[lang] = total.get(lang, 0) + v
    if total:
        vectors = pa.ListArray.from_arrays(np.arange(len(total) + 1, dtype=np.int32) * DIMENSIONS, pa.array(np.concatenate([*total.values()])))
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), vectors], ["lang", "bundle"])


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, unit vectors, from about fit_docs documents of each language, chosen by a
    hash of the id. Bundles are summed by Spark; what reaches the driver is a number for each language and dimension.

    Rows with a null language or text teach nothing. More than MOST_LANGUAGES languages are an error.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("lang")).filter(
        "lang IS NOT NULL AND _text IS NOT NULL"
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    if not counts:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, fit_docs / n))])
    chosen = rows.filter(F.coalesce(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30), F.lit(False)))
    bundles = chosen.select("_text", "lang").mapInArrow(_bundles, "lang string, bundle array<double>")
    sums = bundles.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    got = sums.orderBy("lang", "at").toArrow()
    vectors = got.column("x").to_numpy().reshape(-1, DIMENSIONS)
    langs = got.column("lang").to_pylist()[::DIMENSIONS]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return langs, (vectors / np.where(length == 0, 1, length)).astype(np.float32)


class Products:
    """The products of trigram vectors with all prototypes, of a bounded number of trigrams."""

    def __init__(self, prototypes: np.ndarray):
        self.profile = np.ascontiguousarray(prototypes.T)
        self.grams, self.product = np.zeros(0, np.int64), np.zeros((0, len(prototypes)), np.float32)

    def of(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, grams)
        new = grams[(self.grams[np.minimum(at, len(self.grams) - 1)] != grams)] if len(self.grams) else grams
        if len(new):
            made = [2 * (gram_vectors(new[i : i + 2048]) @ self.profile) - self.profile.sum(0) for i in range(0, len(new), 2048)]
            keep = len(self.grams) + len(new) <= KEPT
            every = np.concatenate([self.grams, new]) if keep else np.concatenate([new, (old := np.setdiff1d(grams, new))])
            rows = np.concatenate([self.product, *made] if keep else [*made, self.product[np.searchsorted(self.grams, old)]])
            order = np.argsort(every)
            self.grams, self.product = every[order], rows[order]
            at = np.searchsorted(self.grams, grams)
        return self.product[at].astype(float)


def _predicted(langs: list[str], prototypes) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A document's vector is the bundle of its trigrams' vectors, so its product with a prototype is the sum of theirs.
        products = Products(prototypes.value)
        for batch in batches:
            best, scores = [], []
            for _, _, data, offsets in T.chunks(batch.column("_text")):
                for _, _, grams, counts in counted(data, offsets):
                    # Trigram vectors are nearly orthogonal: the bundle's squared length is DIMENSIONS * sum(count^2), nearly.
                    length = np.sqrt(DIMENSIONS * (counts.astype(float) ** 2).sum(1))
                    cosine = counts @ products.of(grams) / np.maximum(length, 1)[:, None]
                    none = length == 0
                    if langs:
                        at = cosine.argmax(1)
                        best += [UNKNOWN if z else langs[k] for z, k in zip(none, at, strict=True)]
                        scores += np.where(none, 0.0, np.clip(cosine[np.arange(len(at)), at], 0, 1)).tolist()
                    else:
                        best += [UNKNOWN] * len(none)
                        scores += [0.0] * len(none)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return step


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Whole texts are profiled: letters of any script, case folded, get random vectors by their code point; permuted and multiplied in
    threes they make trigram vectors, whose sum is compared with each language's prototype by cosine. The
    best language wins, the first by name on a tie; score is its cosine, cut to 0..1, with the sum's expected length (which all
    languages share) in place of its own. held_out says that crc32 of the id as text leaves no remainder by 5.

    A null text, or one without a letter, is und with score 0, as all texts are if no language was learned.
    Null ids are not held out; repeated rows repeat their result. The text alone decides, whatever its length; other columns are
    not read. Empty tables give no rows. No shuffle.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("_text"))
    langs, prototypes = model
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)
    return rows.mapInArrow(_predicted(langs, shared), "doc_id long, held_out boolean, lang_pred string, score double")


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """identify() with prototypes from the rows that are not held out and whose language is known."""
    seen = docs.filter(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) != 0)
    return identify(docs, fit(seen, id_col, text_col, lang_col), id_col, text_col)
