"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one for each shard of the index."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import attach, written

DEGREE, BEAM, ALPHA = 32, 96, 1.2
#: Vectors of a shard, about; a graph and its vectors are held by one task.
SHARD_ROWS = 4096
#: Each graph's beam is doubled until its search finds this share of the exact nearest of so many of its own rows.
LEAST_RECALL, PROBES, PROBED = 0.97, 64, 20
#: Queries that one task searches a shard for.
QUERY_ROWS = 20_000
#: Nodes of the beam that are expanded at a time.
WIDTH = 4
#: Longest to shortest norm of the vectors that share a graph: with long and short ones in one, the long ones fill
#: every beam and the edges between the short ones are not reached.
NORM_RATIO = 2.0


class Points(NamedTuple):
    """Vectors in doubles, scaled so that the largest component is 1, their squared lengths, and the one more
    component (lift) that gives all rows one length, so that the nearest has the largest inner product.

    Distances are sums over the vectors' own lengths and the difference of lifts, never differences of products
    of lifted rows, in which one long vector would cancel the distances of all others."""

    x: np.ndarray
    square: np.ndarray
    lift: np.ndarray

    def closeness(self, nodes: np.ndarray, vectors: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """Of each node, the product with its vector; with own, whose rows the vectors are, the negative squared
        distance of the lifted rows plus the row's squared length."""
        product = np.einsum("ij,ij->i", self.x[nodes], vectors)
        return product if own is None else 2 * product - self.square[nodes] - self.gap(own, nodes) ** 2

    def gap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The difference of the lifts of rows a and b, from their squared lengths."""
        total = self.lift[a] + self.lift[b]
        return np.divide(self.square[b] - self.square[a], total, out=np.zeros(total.shape), where=total > 0)


def lifted(x: np.ndarray) -> Points:
    x = x / np.abs(x).max()
    square = np.einsum("ij,ij->i", x, x)
    return Points(x, square, np.sqrt(square.max() - square))


def beam_search(points: Points, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, own: np.ndarray | None = None):
    """Greedy searches for all queries at once: beams (node, closeness), best first, and, for queries that are
    points themselves (own: their rows), what each search expanded."""
    n, q = len(points.x), len(queries)
    beam = min(beam, n)
    nodes = np.full((q, beam), -1, np.int64)
    value = np.full((q, beam), -np.inf)
    done = np.ones((q, beam), bool)
    nodes[:, 0], value[:, 0], done[:, 0] = start, points.closeness(np.full(q, start), queries, own), False
    seen = np.zeros((q, n), bool)
    seen[:, start] = True
    trail: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(q)
    while len(active):
        rank = np.where(done[active], -np.inf, value[active])
        take = np.argpartition(-rank, min(WIDTH, beam) - 1, axis=1)[:, :WIDTH] if beam > WIDTH else np.tile(np.arange(beam), (len(active), 1))
        good = np.take_along_axis(rank, take, 1) > -np.inf
        at = np.where(good, nodes[active[:, None], take], -1)
        done[active[:, None], take] = True
        if own is not None:
            trail.append((active, at, value[active[:, None], take]))
        near = np.where((at >= 0)[:, :, None], graph[at], -1).reshape(len(active), -1)
        fresh = (near >= 0) & ~seen[active[:, None], near]
        near = np.where(fresh, near, -1)
        # A node may be a neighbour of several expanded ones: keep one of each.
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = near >= 0
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        close = np.full(near.shape, -np.inf)
        close[r, c] = points.closeness(near[r, c], queries[active[r]], None if own is None else own[active[r]])
        every = np.concatenate([value[active], close], axis=1)
        best = np.argpartition(-every, beam - 1, axis=1)[:, :beam] if every.shape[1] > beam else np.tile(np.arange(beam), (len(active), 1))
        value[active] = np.take_along_axis(every, best, 1)
        nodes[active] = np.take_along_axis(np.concatenate([nodes[active], near], axis=1), best, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), best, 1)
        active = active[(~done[active] & (value[active] > -np.inf)).any(1)]
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(value, order, 1), trail


def robust_prune(points: Points, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each own point's candidates (-1: none), up to `degree`: the nearest, then the nearest that no chosen
    one is alpha times nearer to than the point itself, and so on."""
    safe = np.maximum(candidates, 0)
    vectors, square = points.x[safe], points.square[safe]

    def distance(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        return square + points.square[rows][:, None] - 2 * np.einsum("bcd,bd->bc", vectors, x) + points.gap(rows[:, None], safe) ** 2

    away = distance(own, points.x[own])
    alive = (candidates >= 0) & (candidates != own[:, None])
    away = np.where(alive, np.maximum(away, 0), np.inf)
    out = np.full((len(own), degree), -1, np.int64)
    line = np.arange(len(own))
    for k in range(degree):
        pick = np.where(alive, away, np.inf).argmin(1)
        live = alive[line, pick]
        if not live.any():
            break
        out[live, k] = candidates[line, pick][live]
        between = np.maximum(0, distance(safe[line, pick], vectors[line, pick]))
        alive &= (alpha * alpha * between > away) & live[:, None]
        alive[line, pick] = False
        alive &= candidates != candidates[line, pick][:, None]
    return out


def build(points: Points, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """The graph over points of one length, neighbours by row (-1: none), and its entry: points enter in random
    order and growing batches; each is searched for, and what its search expanded is pruned to its edges."""
    n = len(points.x)
    graph = np.full((n, 2 * degree), -1, np.int64)
    start = int((points.square - 2 * points.x @ points.x.mean(0) + (points.lift - points.lift.mean()) ** 2).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        batch = order[at : at + size]
        at, size = at + len(batch), min(512, max(1, (at + len(batch)) // 2))
        nodes, _, trail = beam_search(points, graph, start, points.x[batch], beam, own=batch)
        steps = [nodes]
        for rows, expanded, _ in trail:
            part = np.full((len(batch), expanded.shape[1]), -1, np.int64)
            part[rows] = expanded
            steps.append(part)
        candidates = np.concatenate(steps, axis=1)
        candidates.sort(axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        candidates = -np.sort(-candidates, axis=1)
        candidates = candidates[:, : max(1, int((candidates >= 0).sum(1).max()))]
        chosen = robust_prune(points, batch, candidates, degree, alpha)
        graph[batch, :degree] = chosen
        r, c = np.nonzero(chosen >= 0)
        _back(points, graph, chosen[r, c], batch[r], degree, alpha)
    over = np.flatnonzero((graph >= 0).sum(1) > degree)
    for i in range(0, len(over), 1024):
        rows = over[i : i + 1024]
        kept = robust_prune(points, rows, graph[rows], degree, alpha)
        graph[rows] = -1
        graph[rows, :degree] = kept
    graph = -np.sort(-graph, axis=1)
    return graph[:, :degree], start


def _back(points: Points, graph: np.ndarray, to: np.ndarray, source: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the edges to -> source; a row that overflows is pruned."""
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    rows, first, count = np.unique(to, return_index=True, return_counts=True)
    room = graph.shape[1]
    have = (graph[rows] >= 0).sum(1)
    fits = have + count <= room
    for row, f, c in zip(rows[fits], first[fits], count[fits], strict=True):
        line = graph[row]
        line[np.flatnonzero(line < 0)[:c]] = source[f : f + c]
    for width in (2 * room, 8 * room, len(points.x)):
        some = ~fits & (have + count <= width)
        fits |= some
        picked = np.flatnonzero(some)
        step = max(1, 65536 // max(1, min(width, int((have + count)[picked].max(initial=1)))))
        for i in range(0, len(picked), step):
            part = picked[i : i + step]
            wide = np.full((len(part), int((have + count)[part].max())), -1, np.int64)
            for k, p in enumerate(part):
                line = graph[rows[p]]
                line = line[line >= 0]
                wide[k, : len(line)] = line
                wide[k, len(line) : len(line) + count[p]] = source[first[p] : first[p] + count[p]]
            kept = robust_prune(points, rows[part], wide, degree, alpha)
            graph[rows[part]] = -1
            graph[rows[part], :degree] = kept


def _stacked(column: pd.Series, kind: type = np.float64) -> np.ndarray:
    return np.array([np.asarray(v, kind) for v in column], kind)


def bands(x: np.ndarray) -> np.ndarray:
    """The band of each vector: within one, norms differ by NORM_RATIO at most; 0 holds the longest."""
    most = np.abs(x).max(1, keepdims=True)
    norm = np.log(most[:, 0]) + np.log(((x / most) ** 2).sum(1)) / 2
    order = np.argsort(-norm, kind="stable")
    fall, band = -norm[order], np.empty(len(x), np.int64)
    at = k = 0
    while at < len(order):
        end = int(np.searchsorted(fall, fall[at] + np.log(NORM_RATIO), "right"))
        band[order[at:end]] = k
        at, k = end, k + 1
    return band


def needed_beam(points: Points, graph: np.ndarray, start: int, beam: int = BEAM, seed: int = 5) -> int:
    """The beam at which searches of this graph find LEAST_RECALL of the exact nearest of a sample of its rows; all rows, where no
    smaller one does: then searches are exact."""
    n = len(points.x)
    probes = np.random.default_rng(seed).permutation(n)[:PROBES]
    product = points.x[probes] @ points.x.T
    top = min(PROBED, n)
    least = -np.partition(-product, top - 1, axis=1)[:, top - 1]
    while beam < n:
        nodes, value, _ = beam_search(points, graph, start, points.x[probes], beam)
        # Ties with the last of the nearest are as near.
        if ((value[:, :top] >= least[:, None] - 1e-12).sum() >= LEAST_RECALL * top * len(probes)):
            return beam
        beam *= 2
    return n


def _graph(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf["band"] = bands(_stacked(pdf["v"]))
    pdf = pdf.sort_values(["band", "cid", "twin"], ignore_index=True)
    starts, beams, edges = [], [], []
    for _, part in pdf.groupby("band"):
        points = lifted(_stacked(part["v"]))
        graph, start = build(points)
        starts.append(np.arange(len(part)) == start)
        beams.append(np.full(len(part), needed_beam(points, graph, start)))
        edges += [list(r[r >= 0]) for r in graph]
    return pdf.assign(start=np.concatenate(starts), beam=np.concatenate(beams), near=edges)


def _search(top: int, least_beam: int) -> Callable:
    def step(queries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "cid": pd.Series(dtype="int64"), "twin": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(nodes):
            return empty
        wanted, ids = _stacked(queries["v"]), queries["query_id"].to_numpy()
        unit = wanted / np.abs(wanted).max(1, keepdims=True)
        first = lambda rows: rows.sort_values(["query_id", "score", "cid", "twin"], ascending=[True, False, True, True]).groupby("query_id").head(top)
        parts = []
        for _, part in nodes.sort_values(["band", "cid", "twin"], ignore_index=True).groupby("band"):
            exact, cids, twins = _stacked(part["v"]), part["cid"].to_numpy(), part["twin"].to_numpy()
            points, start = lifted(exact), int(part["start"].to_numpy().argmax())
            beam = max(least_beam, int(part["beam"].iloc[0]))
            graph = np.full((len(part), DEGREE), -1, np.int64)
            for i, near in enumerate(part["near"]):
                graph[i, : len(near)] = near
            block = max(1, min(512, (1 << 24) // max(len(part), 4 * beam)))
            for i in range(0, len(ids), block):
                q = wanted[i : i + block]
                if len(part) <= beam:
                    found = np.tile(np.arange(len(part)), (len(q), 1))
                    r, c = np.nonzero(found >= 0)
                else:
                    found, value, _ = beam_search(points, graph, start, unit[i : i + block], beam)
                    r, c = np.nonzero((value > -np.inf)[:, : 2 * top])
                score = (exact[found[r, c]] * q[r]).sum(1)
                parts.append(first(pd.DataFrame({"query_id": ids[i + r], "cid": cids[found[r, c]], "twin": twins[found[r, c]], "score": score})))
        return first(pd.concat(parts))

    return step


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles) and dim of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("v"))


def index(vectors: DataFrame, top: int) -> tuple[DataFrame, DataFrame, int]:
    """(classes, nodes, shards): equal vectors as a class with its smallest ids, top + 1 at most (more can't be
    among the top of any query); and the shards' graphs over all classes, rows with their neighbours, which are
    places in the order of cid and twin within shard and band. A class is named by its smallest id and a hash of its vector, as an id
    may be repeated with other vectors."""
    w = W.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("dim").alias("dim"))
    classes = written(classes.withColumns({"cid": F.element_at("ids", 1), "twin": F.xxhash64("v")}), "ann-classes")
    shards = max(1, -(-classes.count() // SHARD_ROWS))
    rows = classes.select("dim", F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int").alias("shard"), "cid", "twin", "v")
    schema = "dim int, shard int, cid long, twin long, v array<double>, band int, start boolean, beam int, near array<int>"
    # By range, so that shards are spread over tasks evenly.
    rows = rows.repartitionByRange(_tasks(shards), "dim", "shard")
    return classes, written(rows.groupBy("dim", "shard").applyInPandas(_graph, schema), "ann-graphs"), shards


def _tasks(groups: int) -> int:
    """Partitions for groups that take a task each: few share one, and small ones are not put together."""
    return min(8192, 2 * groups)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of queries the `top` rows of vectors with the largest inner
    product found, largest first, ties to the smaller id. The row with the query's own id is no candidate.

    Every vector is indexed: equal vectors as one class, classes hashed to shards, a graph for each band of norms of
    a shard. Every query searches every graph with a beam that a sample of the graph's own rows has set (needed_beam); scores are
    exact, in doubles, on the original vectors.

    Vectors (and queries) that are null, zero, or hold a null or non-finite component take no part, nor do
    rows with a null id; vectors meet only those of their own length. Rows that repeat an id with another
    vector are candidates each. Fewer candidates than `top` are all returned; empty tables give no rows.
    """
    classes, nodes, shards = index(valid_vectors(vectors, id_col, vector_col), top)
    asked = valid_vectors(queries, id_col, vector_col).withColumnRenamed("vec_id", "query_id")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("dim", every(shards).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "v")
    right = nodes.withColumn("block", every(blocks))
    tasks = _tasks(shards * blocks)
    left, right = (d.repartition(tasks, "dim", "shard", "block") for d in (left, right))
    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block"))
    found = found.applyInPandas(_search(top + 1, beam), "query_id long, cid long, twin long, score double").dropDuplicates(["query_id", "cid", "twin"])
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "cid", "twin")
    best = written(found.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= top + 1).drop("r"), "ann-found")
    asked_of = written(best.groupBy("cid", "twin").agg(F.count("*").alias("n")).join(classes.select("cid", "twin", "ids"), ["cid", "twin"]), "ann-members")
    rows = attach(best, asked_of, ["cid", "twin"], "n", best.count()).select("query_id", F.explode("ids").alias("vec_id"), "score").distinct()
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.filter("vec_id != query_id").withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
