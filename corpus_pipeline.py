"""A training corpus from documents: good ones, without repeated lines and near copies, mixed by source, as piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import lines, mixing, near, pieces, quality
from tidewater.llm.common import written
from tidewater.session import table


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars of their texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier does not reject; it is fitted on the rated documents of the input.

    Rows are judged by their texts alone, repeated ones alike; null and empty texts as texts without words; of any length. Null
    ids and other columns stay as they are. Without labels every document stays; empty tables give no rows."""
    rated = quality.graded(table(spark, sf_dir, "labels"))
    return quality.good(docs, quality.fit(rated, docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that five or more of them share but in the last one.

    Null and empty texts stay as they are, as do the lines of rows with a null id, which count as documents. Rows that repeat the
    largest id all keep a line. Texts of any length are split whole; empty tables give no rows."""
    return _measured(lines.without_repeats(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; rows with a null id come after all others, and of
    rows that share an id any one stays.

    Every row is a document of its own. Null and empty texts have no copies and stay; texts of any length are compared whole;
    empty tables give no rows."""
    return near.without_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for; a repeat is a row.

    Null and empty texts have no words and are not taken. A null source is a source of its own. Rows equal in id and text tie and
    are exchangeable, null ids too; the document at a source's cut gives its first words once. Empty tables give no rows."""
    return _measured(mixing.mixed(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of every row, and whether decoding them gives the text again.

    A null text has null ids and round_trip and 0 pieces, an empty one no ids. Null ids and repeated rows keep their places;
    texts of any length are encoded whole; other columns go. Empty tables give no rows."""
    coded = pieces.encode(docs, pieces.load(), check=True)
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("near dedup", drop_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The classifier and the pieces are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what one leaves is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
