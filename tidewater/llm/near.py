"""MinHash near-dedup on SetSketch registers: bands propose, a joint likelihood estimates, full sets decide."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import tokens as T
from tidewater.llm.common import attach, fresh, likely_in, without, written
from tidewater.llm.graph import components

SHINGLE = 5
#: Registers of a sketch, and how many in a row make a band. A pair at 0.75 shares no band once in 200,000.
REGISTERS, BAND = 128, 4
#: Register i of a set is floor(1 - log_BASE(x)), cut to 0..TOP + 1, with x the least of its elements'
#: exponential variables of rate RATE.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Pairs that the likelihood puts this far below the threshold, over five standard errors, are not verified.
MARGIN = 0.2
#: Members of one center, and of one block of a bucket, that a task compares at a time: by sketches and by texts.
MEMBERS, SKETCHES, TEXTS = 128, 4096, 512

FACTORS = T.stream(REGISTERS, 11) | np.uint64(1)


def registers(elements: np.ndarray) -> np.ndarray:
    """The SetSketch of a non-empty set of 64-bit hashes; that of a union is the maximum of the sketches."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(elements), 1024):
        np.minimum(least, (elements[i : i + 1024, None] * FACTORS).min(0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def likely_jaccard(n_u: np.ndarray, n_v: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Maximum likelihood Jaccard similarity of pairs of sets of sizes n_u, n_v, of whose registers
    `above` are greater in the first set and `below` in the second; the log-likelihood is concave."""
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    equal = REGISTERS - above - below
    scale = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * scale) / math.log(BASE)

    def score(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return above * np.log(a) + below * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        better = score(left) < score(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Of each row, the sorted distinct hashes of its shingles of lower-cased words."""
    for first, last, data, offsets in T.chunks(column):
        w = T.words(data, offsets)
        runs, rows = w.shingles(w.hashes(T.FOLDED), SHINGLE)
        cut = np.searchsorted(rows, np.arange(last - first + 1))
        for i in range(last - first):
            yield np.unique(runs[cut[i] : cut[i + 1]])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, sketches = [], [], []
        for elements in shingle_sets(batch.column("_text")):
            sizes.append(len(elements))
            keys.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None)
            sketches.append(registers(elements).tobytes() if len(elements) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("twin"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
            ["doc_id", "twin", "n_shingles", "set_key", "sketch"],
        )


def sketch(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, twin, _text): doc_id, twin, n_shingles, set_key (128 bits of the set) and sketch; the last two are null for
    an empty set."""
    return rows.mapInArrow(_sketches, "doc_id long, twin long, n_shingles long, set_key binary, sketch binary")


def _beside_center(pairs: DataFrame, payload: DataFrame, step: Callable, what: str) -> DataFrame:
    """step over the rows of pairs (a, b) with the payload of b, each center a's own payload before its members.

    Centers with many members are dealt to several tasks with a copy of the center in each.
    """
    total = pairs.count()
    centers = written(pairs.groupBy("a").agg(F.count("*").alias("members")), f"{what}-centers")
    parts = F.ceil(F.col("members") / MEMBERS).cast("int")
    dealt = attach(pairs, centers, "a", "members", total).withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int"))
    members = dealt.select("a", "part", "b").join(payload.withColumnRenamed("key", "b"), "b").withColumn("member", F.lit(1))
    own = centers.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("a").alias("b"))
    own = own.join(payload.withColumnRenamed("key", "b"), "b").withColumn("member", F.lit(0))
    rows = members.unionByName(own).repartition("a", "part").sortWithinPartitions("a", "part", "member")
    return rows.mapInArrow(step, "u binary, v binary")


def _told(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["u", "v"])


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _estimated(least: float) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch_of, n_of = None, 0
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            member, n = batch.column("member").to_numpy(), batch.column("n_shingles").to_numpy()
            regs = _registers_of(batch.column("sketch"))
            # Rows of a center come after it: of each row, the last center's row, or the one of an earlier batch.
            last = np.maximum.accumulate(np.where(member == 0, np.arange(len(member)), -1))
            mine, size = regs[last], n[last].astype(float)
            if (last < 0).any():
                mine[last < 0], size[last < 0] = sketch_of, n_of
            sketch_of, n_of = mine[-1].copy(), size[-1]
            j = likely_jaccard(size, n.astype(float), (mine > regs).sum(1), (mine < regs).sum(1))
            keep = pa.array((member == 1) & (j >= least))
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["u", "v"])

    return step


def _meets(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _verified(threshold: int) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            a, b, member = (batch.column(x).to_pylist() for x in ("a", "b", "member"))
            links = []
            for x, y, m, elements in zip(a, b, member, shingle_sets(batch.column("_text")), strict=True):
                if not m:
                    own = elements
                elif _meets(own, elements, threshold):
                    links.append((x, y))
            yield _told(links)

    return step


def _across(least: float, threshold: int, tell: str) -> Callable:
    """Blocks of a bucket, rows sorted by block: likely pairs of an outsider and a member of another component.

    A pair is compared in its first common band alone. tell: "keys", every row of such a pair, once for each task; "links", pairs
    whose full sets meet the threshold, without those that join nothing new within the block, so that a block tells fewer
    links than it has rows.
    """
    told: set[bytes] = set()

    def compare(band: int, rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        key = [r[0] for r in rows]
        comp = np.unique(np.array([r[1] for r in rows], object), return_inverse=True)[1].reshape(-1)
        out, n = (np.array([r[i] for r in rows]) for i in (2, 3))
        regs = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(len(rows), REGISTERS)
        bands = regs.view(np.uint64)
        sets = list(shingle_sets(pa.array([r[5] for r in rows], pa.string()))) if tell == "links" else None
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while c in parent:
                c = parent[c]
            return c

        inner = np.flatnonzero(out == 0)
        for x in np.flatnonzero(out == 1).tolist():
            # No pair at the threshold has sizes further apart, or fewer than half of its registers equal (by eight errors).
            fits = (np.minimum(n, n[x]) >= threshold / 100 * np.maximum(n, n[x]))[inner]
            other = inner[fits & (comp[inner] != comp[x])]
            other = other[(regs[other] == regs[x]).sum(1) >= 0.4 * REGISTERS]
            other = other[(bands[other] == bands[x]).argmax(1) == band]
            if not len(other):
                continue
            j = likely_jaccard(
                np.full(len(other), float(n[x])), n[other].astype(float), (regs[x] > regs[other]).sum(1), (regs[x] < regs[other]).sum(1)
            )
            likely = other[np.argsort(-j, kind="stable")][: int((j >= least).sum())].tolist()
            if tell == "keys":
                new = {key[i] for i in (x, *likely)} - told if likely else set()
                told.update(new)
                yield from ((k, k) for k in new)
            else:
                for y in likely:
                    a, b = find(comp[x]), find(comp[y])
                    if a != b and _meets(sets[x], sets[y], threshold):
                        parent[max(a, b)] = min(a, b)
                        yield key[x], key[y]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        names = ["bucket", "band", "i", "j", "key", "comp", "out", "n_shingles", "sketch"] + ["_text"] * (tell == "links")
        for batch in batches:
            links: list[tuple[bytes, bytes]] = []
            for bucket, band, i, j, *row in zip(*[batch.column(x).to_pylist() for x in names], strict=True):
                if at != (bucket, band, i, j):
                    if rows:
                        links += compare(at[1], rows)
                    at, rows = (bucket, band, i, j), []
                rows.append(row)
            yield _told(links)
        if rows:
            yield _told(list(compare(at[1], rows)))

    return step


def _open_buckets(members: DataFrame, found: DataFrame, total: int, what: str) -> DataFrame:
    """The members (bucket, band, key) of buckets that hold several components, with their component and whether they are outside
    of that of the bucket's center, sized."""
    now = members.filter("n > 2").join(found.select(F.col("node").alias("key"), "component"), "key", "left")
    now = written(now.withColumn("comp", F.coalesce("component", "key")).drop("component"), f"{what}-members-now")
    main = now.groupBy("bucket").agg(
        F.max(F.when(F.col("key") == F.col("center"), F.col("comp"))).alias("main"), F.count("*").alias("all"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    main = written(main.filter("low != high").select("bucket", "main", "all"), f"{what}-open")
    apart = attach(now.drop("n", "center"), main, "bucket", "all", total).withColumn("out", F.col("comp") != F.col("main")).drop("all", "main")
    return _sized(written(apart, f"{what}-apart"), total, what)


def _sized(apart: DataFrame, total: int, what: str) -> DataFrame:
    """apart with all and outs, the members and outsiders of each bucket."""
    sizes = written(apart.groupBy("bucket").agg(F.count_if("out").alias("outs"), F.count("*").alias("all")), f"{what}-sizes")
    return attach(apart, sizes, "bucket", "all", total)


def _blocks(apart: DataFrame, payload: DataFrame, size: int) -> DataFrame:
    """Every outsider beside all members of its bucket, in blocks of about `size` of each: rows with the payload, sorted by block."""
    across, down = F.ceil(F.col("all") / size).cast("int"), F.ceil(F.greatest(F.col("outs"), F.lit(1)) / size).cast("int")
    i, j = F.pmod(F.xxhash64("key"), across).cast("int"), F.pmod(F.xxhash64("key"), down).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = apart.filter("out").select("bucket", "band", every(across).alias("i"), j.alias("j"), "key", "comp", F.lit(1).alias("out"))
    right = apart.select("bucket", "band", i.alias("i"), every(down).alias("j"), "key", "comp", F.lit(0).alias("out"))
    rows = left.unionByName(right).join(payload, "key")
    return rows.repartition("bucket", "band", "i", "j").sortWithinPartitions("bucket", "band", "i", "j")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct shingles of five words, lower-cased A-Z; with one to four words, all of
    them as one shingle. Documents whose sets have 100 * intersection >= threshold * union are linked;
    component_id is the smallest id that links reach, and that document is kept.

    Equal sets are one class, with 128 bits of the set as its key, compared once. Bands of SetSketch registers put classes into
    buckets; every class is compared with its bucket's smallest key (linear in the bucket), which unites groups of copies.
    Buckets that then hold several components are compared member by member, in blocks: first by sketches alone, which find the
    documents in likely pairs between components; then the texts of these, again in blocks. A pair goes to the exact test of full sets only if the joint likelihood of both
    sketches allows the threshold.

    Null or empty texts have an empty set, are linked with nothing and are kept. Rows that repeat an id are
    documents of their own with that id: with the same text they are equal, with other texts they may be in other components,
    and every row whose id is its component's smallest is kept. Rows with a null
    id are joined to the component of their text but are never its smallest id; with none but null ids,
    component_id is null and the rows are kept. Texts of any length are read whole. Other columns are not read. Empty tables
    give no rows.
    """
    least = threshold / 100 - MARGIN
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("twin", F.xxhash64("_text"))
    sketched = written(sketch(rows), "near-sketches")
    full = sketched.filter(F.col("set_key").isNotNull())
    groups = full.groupBy("set_key").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "twin"))).alias("rep"),
        F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
    ).withColumnRenamed("set_key", "key")
    groups = written(groups, "near-classes")
    classes = groups.filter("rep IS NOT NULL")
    sketches = classes.select("key", "n_shingles", "sketch")
    reps = classes.select("key", "rep.doc_id", "rep.twin")
    text = rows.filter("doc_id IS NOT NULL")
    cut = f"transform(sequence(0, {REGISTERS // BAND - 1}), j -> xxhash64(j, substring(sketch, j * {2 * BAND} + 1, {2 * BAND})))"
    bands = sketches.select(F.posexplode(F.expr(cut)).alias("band", "bucket"), "key")
    buckets = written(bands.groupBy("bucket").agg(F.min("key").alias("center"), F.count("*").alias("n")).filter("n > 1"), "near-buckets")
    total = classes.count() * (REGISTERS // BAND)
    members = written(attach(bands, buckets, "bucket", "n", total), "near-members")
    pairs = members.filter("key != center").select(F.col("center").alias("a"), F.col("key").alias("b")).distinct()
    pairs = written(pairs, "near-pairs")
    likely = _beside_center(pairs, sketches, _estimated(least), "near-estimate")
    links = _exact(written(likely, "near-likely"), reps, text, threshold)
    found = written(components(links), "near-components")

    apart = written(_open_buckets(members, found, total, "near-first"), "near-apart")
    if not apart.isEmpty():
        some = _blocks(apart, sketches, SKETCHES).mapInArrow(_across(least, threshold, "keys"), "u binary, v binary")
        some = written(some.select(F.col("u").alias("key")).distinct(), "near-some")
        if not some.isEmpty():
            few = _some_texts(some, reps, text).join(sketches, "key")
            apart = _sized(written(apart.drop("all", "outs").join(some, "key", "left_semi"), "near-second"), total, "near-second")
            more = _blocks(apart, few, TEXTS).mapInArrow(_across(least, threshold, "links"), "u binary, v binary")
            more = written(more.distinct(), "near-more")
            found = found if more.isEmpty() else written(components(links.unionByName(more)), "near-components")

    known = classes.select("key", "rep.doc_id").join(found.select(F.col("node").alias("key"), "component"), "key", "left")
    known = written(known.withColumn("component", F.coalesce("component", "key")), "near-known")
    least_id = known.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    known = attach(known.drop("doc_id"), written(least_id, "near-least"), "component", "n", total).select("key", "component_id")
    now = written(groups.select("key", "copies").join(known, "key", "left"), "near-classes-now")
    linked = attach(full.select("doc_id", "n_shingles", F.col("set_key").alias("key")), now, "key", "copies", sketched.count())
    lone = sketched.filter(F.col("set_key").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _some_texts(keys: DataFrame, reps: DataFrame, text: DataFrame) -> DataFrame:
    """key, _text of the given classes: one text for each, however often its row is repeated."""
    wanted = reps.join(keys, "key", "left_semi")
    some = likely_in(text, "doc_id", wanted, "doc_id").groupBy("doc_id", "twin").agg(F.first("_text").alias("_text"))
    return some.join(wanted, ["doc_id", "twin"]).select("key", "_text")


def _exact(pairs: DataFrame, reps: DataFrame, text: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v): the pairs whose full sets meet the threshold. Only texts of pairs are shuffled."""
    keys = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    texts = written(_some_texts(keys, reps, text), "near-texts")
    return written(_beside_center(pairs.toDF("a", "b"), texts, _verified(threshold), "near-verify"), "near-links")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """docs, all columns, with one row of each group that near_dedup links: the one with the smallest id, null ids last, and any one of
    rows that share that id.

    Every row is a document of its own here, whatever its id: repeated rows are copies. Rows without words
    all stay. Columns may have any names; empty tables give no rows. If an id is null or repeated, docs are written once with a number
    for each row; else the ids are the numbers.
    """
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    if ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL").isEmpty():
        lost = written(near_dedup(docs, id_col, text_col, threshold).filter("NOT kept").select("doc_id"), "near-lost")
        return without(docs, id_col, lost, "doc_id")
    row = fresh(docs.columns, "_row")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-numbered")
    found = written(near_dedup(docs, row, text_col, threshold).select(F.col("doc_id").alias("row"), "component_id"), "near-found")
    numbered = found.join(docs.select(F.col(row).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id")), "row")
    best = numbered.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("best"))
    lost = written(found.join(best.select(F.col("best.row").alias("row")), "row", "left_anti").select("row"), "near-lost")
    return without(docs, row, lost, "row").drop(row)
