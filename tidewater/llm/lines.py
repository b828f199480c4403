"""Line dedup: Bloom filters of once- and twice-seen line hashes; only suspected repeats are confirmed exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACES, attach, fresh, split_by_ids, suspects, written

STRIP = SPACES.encode()


def line_keys(text: bytes, least_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and of each its key if that has the least code points."""
    lines = text.split(b"\n")
    # Continuation bytes of UTF-8 are no code points; bytes.lower() folds A-Z alone.
    keys = [line.strip(STRIP).lower() for line in lines]
    return lines, [k if len(k) >= least_chars and (k.isascii() or len(k.decode("utf-8", "replace")) >= least_chars) else None for k in keys]


def digest(key: bytes) -> bytes:
    """128 bits of a key; their first half is its hash in the filters."""
    return hashlib.blake2b(key, digest_size=16).digest()


def _parsed(least_chars: int) -> Callable:
    """Each document with its undropped result, and the two halves of the digests of its distinct keys."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, digests, ends = [], [], [], [0]
            for value in batch.column("_text").cast(pa.binary()):
                text = value.as_py() or b""
                lines, keys = line_keys(text, least_chars)
                some = {k for k in keys if k is not None}
                digests += map(digest, some)
                ends.append(len(digests))
                counts.append(len(lines))
                shas.append(hashlib.sha256(text).hexdigest())
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(halves[:, k])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("twin"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), *lists],
                ["doc_id", "twin", "n_lines", "kept_sha256", "one", "two"],
            )

    return step


def kept_lines(text: bytes, one: list[int], two: list[int], least_chars: int) -> tuple[list[bytes], int]:
    """The lines that stay without those of the given digests, and the number of all lines."""
    lines, keys = line_keys(text, least_chars)
    gone = set(zip(one, two, strict=True))
    lost = lambda k: k is not None and tuple(np.frombuffer(digest(k), np.int64).tolist()) in gone
    return [x for x, k in zip(lines, keys, strict=True) if not lost(k)], len(lines)


def _cut(least_chars: int) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, dropped, texts = [], [], []
            for value, one, two in zip(batch.column("_text").cast(pa.binary()), batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
                kept, n = kept_lines(value.as_py() or b"", one, two, least_chars)
                counts.append(n)
                dropped.append(n - len(kept))
                texts.append(b"\n".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_lines", "n_dropped", "text"],
            )

    return step


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, _text and twin, a hash of the text, which tells rows with one id apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.withColumn("twin", F.xxhash64("_text"))


def repeated_lines(rows: DataFrame, least_chars: int, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(parsed, drops) of _rows: each document's doc_id, twin, n_lines and SHA-256 as it is; and doc_id, twin, one, two, the
    digests of the line keys that the document loses, for documents that lose any."""
    schema = "doc_id long, twin long, n_lines long, kept_sha256 string, one array<long>, two array<long>"
    parsed = written(rows.mapInArrow(_parsed(least_chars), schema), "lines-parsed")
    held = parsed.select("doc_id", "twin", F.inline(F.arrays_zip("one", "two")))
    total = held.count()
    doubted, _ = suspects(held, "one", total, "lines", alone=False)
    doubted = written(doubted, "lines-suspects")
    # Rows with one id are one holder each; the largest id that holds a line keeps it.
    groups = doubted.groupBy("one", "two").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= least_docs)
    lost = attach(doubted, written(groups, "lines-repeated"), ["one", "two"], "n", total).filter("doc_id != keeper")
    lost = lost.select("doc_id", "twin", "one", "two").distinct()
    drops = lost.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("one", "two")).alias("gone"))
    return parsed.drop("one", "two"), written(drops.select("doc_id", "twin", F.col("gone.one").alias("one"), F.col("gone.two").alias("two")), "lines-drops")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5
) -> DataFrame:
    """One row per row of docs that loses lines: doc_id, n_lines, n_dropped, text without them.

    Texts are split at newlines. A line's key is the line without white space at both ends, A-Z
    lower-cased. Keys of at least least_chars code points that are in at least least_docs documents
    stay only in the document with the largest id; all other lines stay as they are, joined by newlines.

    Null and empty texts are one empty line, which never goes. A document is a row; rows that repeat the
    largest id all keep the lines they hold, and rows of one id with other texts lose their own lines. Rows
    with a null id count as documents; they keep their lines. Texts of any length are read whole, a row at a time.
    Empty tables give no rows; other columns are not read, whatever their names.

    One pass over the texts leaves 128 bits of every document's distinct keys. Their first halves go through the
    filters of once- and twice-seen slots (common.suspects); only suspected repeats are shuffled, and their
    exact counts decide. Of the texts, only those of documents that lose lines are shuffled.
    """
    rows = _rows(docs, id_col, text_col)
    return cut_lines(rows, repeated_lines(rows, least_chars, least_docs)[1], least_chars)


def cut_lines(rows: DataFrame, drops: DataFrame, least_chars: int) -> DataFrame:
    some = split_by_ids(rows, "doc_id", drops, "doc_id")[0].join(drops.hint("shuffle_hash"), ["doc_id", "twin"])
    return some.mapInArrow(_cut(least_chars), "doc_id long, n_lines long, n_dropped long, text string")


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5
) -> DataFrame:
    """docs, all rows and columns, with the texts that line_dedup leaves: its cases hold here too. Null texts stay null, and
    columns may have any names."""
    _, drops = repeated_lines(_rows(docs, id_col, text_col), least_chars, least_docs)
    names = docs.columns
    key, twin, one, two = (fresh(names, x) for x in ("_id", "_twin", "_one", "_two"))
    drops = drops.select(F.col("doc_id").alias(key), F.col("twin").alias(twin), F.col("one").alias(one), F.col("two").alias(two))
    some, rest = split_by_ids(docs, id_col, drops, key)
    place = names.index(text_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, a, b in zip(batch.column(place).to_pylist(), batch.column(one).to_pylist(), batch.column(two).to_pylist(), strict=True):
                texts.append(b"\n".join(kept_lines(value.encode(), a, b, least_chars)[0]).decode() if a else value)
            columns = [pa.array(texts, c.type) if i == place else c for i, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[: len(names)])

    same = (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(text_col) == F.col(twin))
    cut = some.join(drops.hint("shuffle_hash"), same, "left").drop(key, twin).mapInArrow(step, docs.schema)
    return rest.unionByName(cut)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped and kept_sha256 of what line_dedup leaves."""
    rows = _rows(docs, id_col, text_col)
    parsed, drops = repeated_lines(rows, least_chars, least_docs)
    cut = cut_lines(rows, drops, least_chars).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    # Null ids lose nothing, and match nothing here.
    whole = parsed.join(drops.select("doc_id", "twin"), ["doc_id", "twin"], "left_anti")
    return whole.select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), "kept_sha256").unionByName(cut)
