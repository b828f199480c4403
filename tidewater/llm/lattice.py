"""The lattice of words as relations: substrings, an equi-join with the pieces, edges by word, and a Viterbi fold.

pieces.py has the same lattice and fold as columns of a batch, for whole documents; this is the form for tables of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.pieces import MARK, Pieces, lattice_of

PART = "array<struct<size:int,rank:long,until:long>>"
EDGE = f"struct<end:int,start:int,score:double,id:int,rank:long,whole:boolean,heads:{PART},tails:{PART}>"


def piece_table(spark, pieces: Pieces) -> DataFrame:
    """piece, score, id, rank, whole, heads, tails: as many rows as the vocabulary has, which bounds its broadcast. heads and
    tails are the parts of a piece at its start and end that were pieces on its way, with the ranks they came and went at."""
    lattice, names = lattice_of(pieces), pieces.names
    whole = set(lattice.piece.tolist())

    def parts(i: int, side) -> list[tuple[int, int, int]]:
        out, until = [], 1 << 40
        while True:
            rank = int(lattice.rank[i])
            out.append((len(names[i]), rank, until))
            if rank < 0:
                return out
            until, i = rank, int(side[i])

    merges = lambda i, side: parts(i, side) if pieces.merges and i in whole else []
    rows = [(n, float(s), i, int(lattice.rank[i]), i in whole, merges(i, lattice.left), merges(i, lattice.right)) for n, (s, i) in pieces.table.items()]
    return spark.createDataFrame(rows, f"piece string, score double, id int, rank long, whole boolean, heads {PART}, tails {PART}")


def edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, edges in order of (end, start), for all substrings that are pieces. A character in no piece
    has an edge with id -1, 10 below the least score, so that every word has a path."""
    n = F.char_length("word")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.transform(
                F.sequence(i + 1, F.least(n, i + pieces.longest)),
                lambda j: F.struct(i.alias("start"), j.alias("end"), F.substring(F.col("word"), i + 1, j - i).alias("piece")),
            ),
        )
    )
    rows = words.select("word").filter("word != ''").distinct().select("word", F.inline(spans))
    worst = F.lit(min(pieces.scores) - 10.0)
    hits = rows.join(F.broadcast(piece_table(words.sparkSession, pieces)), "piece", "left").filter("id IS NOT NULL OR end = start + 1")
    hits = hits.withColumns({"id": F.coalesce("id", F.lit(-1)), "score": F.coalesce("score", worst), "whole": F.coalesce("whole", F.lit(True))})
    edge = F.struct("end", "start", "score", "id", "rank", "whole", "heads", "tails").cast(EDGE)
    return hits.groupBy("word").agg(F.collect_list(edge).alias("edges")).withColumn(
        "edges", F.array_sort("edges", lambda a, b: F.when(a["end"] != b["end"], a["end"] - b["end"]).otherwise(a["start"] - b["start"]))
    )


def _stays(before: Column, e: Column) -> Column:
    """Whether no edge across the border of two edges would have merged parts of both before they went on."""
    border = e["start"]
    across = lambda c: (
        (c["start"] < border) & (c["end"] > border) & (c["start"] >= before["start"]) & (c["end"] <= e["end"])
        & F.exists(before["tails"], lambda x: (x["size"] == border - c["start"]) & (c["rank"] < x["until"]) & F.exists(
            e["heads"], lambda y: (y["size"] == c["end"] - border) & (c["rank"] <= y["until"]) & (x["rank"] <= y["until"]) & (y["rank"] < x["until"])
        ))
    )
    return ~F.exists("edges", across)


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, ids of its path (-1: a character without a piece), one row per distinct word that is not null or empty.

    The fold goes through the edges by their end and keeps one for each place: for models of scores that of the best sum, the
    longest last piece on a tie; for models of merges the one that merges leave beside the edge kept at
    its start. Words of models of merges have at most one mark, at their start.
    """
    kind = f"array<struct<score:double,start:int,id:int,tails:{PART}>>"
    first = F.transform(
        F.sequence(F.lit(0), F.char_length("word")),
        lambda i: F.struct(F.when(i == 0, F.lit(0.0)).alias("score"), F.lit(0).alias("start"), F.when(i == 0, F.lit(-2)).alias("id"), F.lit(None).cast(PART).alias("tails")),
    ).cast(kind)

    def step(best, e):
        before, old = F.element_at(best, e["start"] + 1), F.element_at(best, e["end"] + 1)["score"]
        score = before["score"] + e["score"]
        way = F.struct(score.alias("score"), e["start"].alias("start"), e["id"].alias("id"), e["tails"].alias("tails"))
        better = old.isNull() | (score > old)
        if pieces.merges:
            better = old.isNull() & before["id"].isNotNull() & e["whole"] & ((before["id"] < 0) | (e["id"] < 0) | _stays(before, e))
        return F.when(
            better, F.concat(F.slice(best, F.lit(1), e["end"]), F.array(way), F.slice(best, e["end"] + 2, F.size(best) - e["end"] - 1)).cast(kind)
        ).otherwise(best)

    folded = edges(words, pieces).withColumn("best", F.aggregate("edges", first, step))
    back = F.aggregate(
        F.sequence(F.lit(1), F.char_length("word")),
        F.struct(F.char_length("word").alias("at"), F.array().cast("array<int>").alias("ids")),
        lambda acc, _: F.when(acc["at"] == 0, acc).otherwise(
            F.struct(
                F.element_at(F.col("best"), F.greatest(acc["at"], F.lit(0)) + 1)["start"].alias("at"),
                F.concat(F.array(F.element_at(F.col("best"), acc["at"] + 1)["id"]), acc["ids"]).alias("ids"),
            )
        ),
    )
    return folded.select("word", back["ids"].alias("ids"))


def words_of(texts: Column) -> Column:
    """The distinct words of a text, each with the mark before it, as encode_words takes them."""
    split = F.filter(F.split(texts, " "), lambda w: w != "")
    return F.array_distinct(F.transform(split, lambda w: F.concat(F.lit(MARK), w)))
