"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import attach, forget, written


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that links (u, v) reach from every linked node.

    Alternates large-star and small-star steps until no link changes, which takes rounds in the
    logarithm of the longest path. Each round is a written table, and the one before it goes. Minima are pre-aggregated, and nodes
    with very many links get their minimum by a bounded broadcast.
    """
    edges = written(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links"
    )
    state = None
    while True:
        total = edges.count()
        if not total:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        old, edges = edges, written(large.filter("u != v").distinct(), "links-large")
        forget(old)
        small = _star(edges, total)
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            small.select("u", F.col("low").alias("v"))
        )
        old, edges = edges, written(small.filter("u != v").distinct(), "links-small")
        forget(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _star(edges: DataFrame, total: int) -> DataFrame:
    """edges with low, the smallest of u and its neighbours v."""
    low = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"), F.count("*").alias("degree"))
    return attach(edges, low, "u", "degree", total)
