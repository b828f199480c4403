"""Exact dedup: two-pass Bloom filtering, then an exact match of the few suspected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import attach, suspects, without_spaces, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space; a null text counts as empty. Of equal
    texts the longest original stays (code points), then the smallest id. DataFrame operations only.

    The first pass counts the Bloom slots of the digests: once-seen or twice-seen. Only rows with a twice-seen slot
    go to the exact grouping by SHA-256, one in 32 of the others at most; all other rows pass through unshuffled.

    Empty tables give no rows. Rows that repeat an id with its text are all of the group, and all of
    those with the kept id are kept. A null id is kept only if its whole group has null ids or it is
    longest; keep_id is then null. Other columns are not read, whatever their names.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    digest = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).select(
            "doc_id", F.unhex(F.sha2(without_spaces(text), 256)).alias("sha"), F.char_length(text).alias("chars")
        ),
        "exact",
    )
    total = digest.count()
    doubted, rest = suspects(digest.withColumn("slot", F.xxhash64("sha")), "slot", total, "exact")
    alone = rest.select(
        "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    doubted = written(doubted.drop("slot"), "exact-suspects")
    groups = written(
        doubted.groupBy("sha").agg(
            # The longest, then the smallest id, null last.
            F.min(F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("unknown"), "doc_id")).alias("best"),
            F.count("*").alias("group_size"),
        ),
        "exact-groups",
    )
    # A Bloom hit that was false is a group of one here.
    matched = attach(doubted, groups, "sha", "group_size", total).select(
        "doc_id",
        "sha",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        ((-F.col("chars") == F.col("best.fewer")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))).alias("kept"),
    )
    return alone.unionByName(matched).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )
