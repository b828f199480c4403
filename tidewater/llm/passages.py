"""Substring dedup: relative Lempel-Ziv factors of documents against the indexed blocks of smaller documents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import tokens as T
from tidewater.llm.common import attach, likely_in, suspects, written

#: Low bits of an ordered value that hold a word's place; a chunk has fewer words.
PLACE = np.uint64((1 << 28) - 1)


@dataclass
class Blocks:
    """Reference blocks of some rows. A window is filed under its anchor, the least of the hashes of the
    runs of window / 2 words in it, which depends on the window's words alone. A block is the longest
    stretch of a row whose windows all have one occurrence of an anchor."""

    row: np.ndarray
    anchor: np.ndarray
    one: np.ndarray  # two 64-bit hashes of all words of the block
    two: np.ndarray
    start: np.ndarray  # first word of the first window, in the chunk
    windows: np.ndarray
    base: np.ndarray  # first word of the row, in the chunk


def blocks_of(w: T.Words, window: int) -> Blocks:
    half = window // 2
    n = len(w.starts) - window + 1
    none = np.zeros(0, np.uint64)
    if n <= 0:
        return Blocks(none.astype(np.int64), none, none, none, none.astype(np.int64), none.astype(np.int64), none.astype(np.int64))
    runs = (T.Runs(w.hashes(T.EXACT, 0), 5), T.Runs(w.hashes(T.EXACT, 1), 6))
    parts = runs[0].of(np.arange(len(w.starts) - half + 1), half)
    place = least_of(((parts & ~PLACE) | np.arange(len(parts), dtype=np.uint64)), window - half + 1) & PLACE
    inside = np.flatnonzero(w.row[:n] == w.row[window - 1 :])
    if not len(inside):
        return Blocks(none.astype(np.int64), none, none, none, inside, inside, inside)
    row, place = w.row[inside], place[inside].astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    at = np.flatnonzero(new)
    start, count = inside[at], np.diff(np.append(at, len(inside)))
    size = count + window - 1
    return Blocks(row[at], parts[place[at]], runs[0].of(start, size), runs[1].of(start, size), start, count, w.first[row[at]])


def least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row: minima to the left and right of every n-th place."""
    pad = np.full(-(-len(x) // n) * n, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(x)] = x
    grid = pad.reshape(-1, n)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(x) - n + 1
    return np.minimum(right[:count], left[n - 1 : n - 1 + count])


def _parsed(window: int) -> Callable:
    """Each document's whole result, and its blocks."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, twins = batch.column("doc_id"), batch.column("twin")
            for first, last, data, offsets in T.chunks(batch.column("_text")):
                w = T.words(data, offsets)
                found = blocks_of(w, window)
                cut = pa.array(np.searchsorted(found.row, np.arange(last - first + 1)), pa.int32())
                raw = data.tobytes()
                shas = [hashlib.sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].split())).hexdigest() for i in range(last - first)]
                longs = [pa.ListArray.from_arrays(cut, pa.array(x.view(np.int64))) for x in (found.anchor, found.one, found.two)]
                places = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (found.start - found.base, found.windows)]
                n = last - first
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), twins.slice(first, n), pa.array(np.diff(w.first), pa.int64()), pa.array(shas), *longs, *places],
                    ["doc_id", "twin", "n_words", "kept_sha256", "anchor", "one", "two", "at", "windows"],
                )

    return step


def _windows(window: int) -> Callable:
    """All windows of the open blocks of texts: their places and 128 bits of their words."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, twins = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "twin"))
            lists = batch.column("open")
            edge, flat = lists.offsets.to_numpy(), lists.flatten()
            at, windows = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            edge = edge - edge[0]
            for first, last, data, offsets in T.chunks(batch.column("_text")):
                w = T.words(data, offsets)
                runs = [T.Runs(w.hashes(T.EXACT, k), 5 + k) for k in (0, 1)]
                some = slice(edge[first], edge[last])
                row = np.repeat(np.arange(first, last), np.diff(edge[first : last + 1]))
                count, place = windows[some], at[some]
                inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                row, place = np.repeat(row, count), np.repeat(place, count) + inside
                one, two = (r.of(w.first[row - first] + place, window) for r in runs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(twins[row]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(place, pa.int32())],
                    ["doc_id", "twin", "one", "two", "at"],
                )

    return step


def factors(matches: list[dict], window: int) -> list[tuple[int, int, int, int]]:
    """The parse of a document from its matches (at, windows, ref_id, ref_at): factors (at, to, ref_id, ref_at), words at..to that
    are the reference's from ref_at on.

    Greedily from left to right: at a place where an indexed block or window begins, the factor goes on while the
    words that follow are those that follow in the same reference, and jumps to its end. The windows across that end are looked at
    next; those that another reference has begin a factor there, which overlaps the last one by less than a window.
    """
    out: list[tuple[int, int, int, int]] = []
    start = end = ref = ref_at = None
    for m in sorted(matches, key=lambda m: m["at"]):
        if m["at"] == end and m["ref_id"] == ref and m["ref_at"] == ref_at + end - start:
            end += m["windows"]
            continue
        if start is not None:
            out.append((start, end + window - 1, ref, ref_at))
        start, end, ref, ref_at = m["at"], m["at"] + m["windows"], m["ref_id"], m["ref_at"]
    return [*out, (start, end + window - 1, ref, ref_at)] if start is not None else out


def _cut(window: int) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts = [], [], []
            for value, matches in zip(batch.column("_text").cast(pa.binary()), batch.column("matches").to_pylist(), strict=True):
                every = (value.as_py() or b"").split()
                spans = factors(matches, window)
                edges = np.zeros(len(every) + 1, np.int64)
                np.add.at(edges, [s[0] for s in spans], 1)
                np.add.at(edges, [s[1] for s in spans], -1)
                gone = np.cumsum(edges[:-1]) > 0
                counts.append(len(every))
                removed.append(int(gone.sum()))
                texts.append(b" ".join(x for x, g in zip(every, gone.tolist(), strict=True) if not g))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "text"],
            )

    return step


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, _text and twin, a hash of the text, which tells rows with one id apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.withColumn("twin", F.xxhash64("_text"))


KEY = ["doc_id", "twin"]


def matched(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(parsed, matches) of _rows: doc_id, twin, n_words and SHA-256 of every document's words; and doc_id, twin, matches, the
    blocks and windows that the index has under a smaller id, for the documents with any."""
    lists = ", ".join(f"{x} array<long>" for x in ("anchor", "one", "two")) + ", at array<int>, windows array<int>"
    parsed = written(rows.mapInArrow(_parsed(window), f"doc_id long, twin long, n_words long, kept_sha256 string, {lists}"), "passages-parsed")
    every = parsed.filter("doc_id IS NOT NULL").select(*KEY, F.inline(F.arrays_zip("anchor", "one", "two", "at", "windows")))
    total = every.count()
    blocks = written(suspects(every, "anchor", total, "passages", alone=False)[0], "passages-blocks")
    first = F.min(F.struct("doc_id", "at"))
    index = blocks.groupBy("one", "two").agg(first.alias("ref"), F.first("anchor").alias("anchor"), F.count("*").alias("n"))
    index = written(index, "passages-index")
    several = index.groupBy("anchor").agg(F.count("*").alias("versions")).filter("versions > 1")
    index = index.select("one", "two", F.col("ref.doc_id").alias("ref_id"), F.col("ref.at").alias("ref_at"), "n")
    # Whole blocks that a smaller document has. Equal rows have equal matches; sets keep them once.
    looked = attach(blocks, index, ["one", "two"], "n", total).select(*KEY, "anchor", "at", "windows", "ref_id", "ref_at")
    looked = written(looked, "passages-looked")
    whole = looked.filter("ref_id < doc_id").select(*KEY, "at", "windows", "ref_id", "ref_at")
    # A block that no smaller document has, but whose anchor has other blocks too, is where factors end: there every window counts.
    own = looked.filter("ref_id = doc_id").select(*KEY, "anchor", "at", "windows")
    open_blocks = attach(own, written(several, "passages-several"), "anchor", "versions", total)
    open_blocks = open_blocks.groupBy(*KEY).agg(F.collect_set(F.struct("at", "windows")).alias("open"))
    open_blocks = written(open_blocks, "passages-open")
    owners = likely_in(rows, "doc_id", open_blocks, "doc_id").join(open_blocks, KEY)
    schema = "doc_id long, twin long, one long, two long, at int"
    windows = written(owners.mapInArrow(_windows(window), schema), "passages-windows")
    seen = windows.groupBy("one", "two").agg(first.alias("ref"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    seen = seen.filter("ref.doc_id < last").select("one", "two", F.col("ref.doc_id").alias("ref_id"), F.col("ref.at").alias("ref_at"), "n")
    across = attach(windows, written(seen, "passages-seen"), ["one", "two"], "n", windows.count()).filter("ref_id < doc_id")
    across = across.select(*KEY, "at", F.lit(1).alias("windows"), "ref_id", "ref_at")
    matches = whole.unionByName(across).groupBy(*KEY).agg(F.collect_set(F.struct("at", "windows", "ref_id", "ref_at")).alias("matches"))
    return parsed.select(*KEY, "n_words", "kept_sha256"), written(matches, "passages-matches")


def cut_factors(rows: DataFrame, matches: DataFrame, window: int) -> DataFrame:
    return likely_in(rows, "doc_id", matches, "doc_id").join(matches, KEY).mapInArrow(
        _cut(window), "doc_id long, n_words long, n_removed long, text string"
    )


def duplicate_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """doc_id, twin, at, to, ref_id, ref_at: the factors of every document, words at..to (exclusive) that are also words
    ref_at.. of a smaller document. twin is a hash of the row's text; equal rows have their factors once."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = zip(batch.column("doc_id").to_pylist(), batch.column("twin").to_pylist(), batch.column("matches").to_pylist(), strict=True)
            found = [(i, t, *f) for i, t, m in every for f in factors(m, window)]
            names = ["doc_id", "twin", "at", "to", "ref_id", "ref_at"]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(6)], names)

    matches = matched(_rows(docs, id_col, text_col), window)[1]
    return matches.mapInArrow(step, "doc_id long, twin long, at long, to long, ref_id long, ref_at long")


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per row of docs that loses words: doc_id, n_words, n_removed, text (kept words joined by a space).

    Every word goes that is in a window of so many consecutive words which also starts in a document with a
    smaller id, judged on the input. Words are runs without white space, unchanged.

    The index has every block (see Blocks) whose anchor was seen twice once, under its first place in the smallest document that has it. A
    document is parsed against it from left to right into factors, copies of one reference as long as that goes on (see
    factors). Where no whole block goes on but its anchor has other blocks, a factor ends inside: there the windows across the
    end are looked up by 128 bits each. A factor has a window's words or more, and all factors are duplicate spans. So a hot
    passage costs a row per block and task, not a pair.

    Null, empty and shorter texts lose nothing. Repeated rows with one id are one document, whatever their texts: each
    row keeps what no smaller id has. Rows with a null id lose nothing and are nobody's reference. A word has its first place on a
    tie. Other columns are not read. Empty tables give no rows.
    """
    rows = _rows(docs, id_col, text_col)
    return cut_factors(rows, matched(rows, window)[1], window)


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed and kept_sha256 of the words passage_dedup leaves."""
    rows = _rows(docs, id_col, text_col)
    parsed, matches = matched(rows, window)
    cut = cut_factors(rows, matches, window).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
    whole = parsed.join(matches.select(*KEY), KEY, "left_anti")
    return whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").unionByName(cut)
