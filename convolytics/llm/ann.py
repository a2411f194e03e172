"""Approximate nearest neighbours by inner product over an NN-descent graph.

Building: vectors are dealt to the leaves of a few random-hyperplane trees
(fitted on a bounded sample), neighbours inside a leaf start the graph, and
NN-descent improves it: at every node its neighbours, those that chose it and
itself meet through a join, are compared there, and each keeps its best, round
after round until few neighbours change. Searching: a query starts from its
own neighbours and greedily expands its best nodes not yet expanded until
that no longer changes its best; a node leads to the vectors that chose it as a neighbour, so
every vector can be reached from as many nodes as it has neighbours.

Inner products become a nearest-neighbour order by one more coordinate that
gives all vectors the same length; scores that are returned are exact
products of the original vectors in double precision. Equal vectors are one
node, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from convolytics.llm.common import drop_staged, require_columns, staged, whole_groups

_NEIGHBOURS = "node long, near array<long>, sim array<float>"
_NODE = np.float16


@dataclass
class Settings:
    neighbours: int = 32
    trees: int = 12
    leaf: int = 1000  # vectors compared with each other in a tree's leaf
    group: int = 8192  # vectors of one task's part of a tree
    sample: int = 16_384  # vectors the trees' hyperplanes are fitted on, at least
    settled: float = 0.01  # NN-descent ends when a smaller share of neighbours changes
    block: int = 256  # vectors compared at a time in a meeting, others in each round
    beam: int = 160  # best nodes a query keeps
    hops: tuple[int, ...] = (32, 128, 160)  # nodes a query expands in each hop; the last goes on until its beam stays
    seed: int = 11


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vector`` (doubles) of the rows that take part: not null, no null,
    NaN or infinite component, not all zero, a non-null id, and of the most
    frequent length (the longer if two are as frequent)."""
    require_columns(vectors, [id_col, vec_col])
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).filter("id is not null and vector is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(fine & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc()).first()
    return rows.filter(F.size("vector") == (sizes["size"] if sizes else 0))


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """``node`` (smallest id of equal vectors), ``vector`` and ``ids`` (their
    ``copies`` smallest ids). Each task keeps only that many of a vector."""
    order = Window.partitionBy("vector").orderBy("id")
    kept = rows.distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= copies)
    return kept.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("node"), "vector", "ids")


def _matrix(column, dtype, width: int | None = None) -> np.ndarray:
    raw = b"".join(x.as_py() for x in column)
    out = np.frombuffer(raw, dtype)
    return out.reshape(len(column), -1) if len(column) else out.reshape(0, width or 1)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and each list's length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def best_of(node: np.ndarray, near: np.ndarray, sim: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Per node its ``k`` most similar distinct others, ties to smaller ids."""
    order = np.lexsort((-sim, near, node))
    node, near, sim = node[order], near[order], sim[order]
    keep = np.ones(len(node), bool)
    keep[1:] = (node[1:] != node[:-1]) | (near[1:] != near[:-1])
    keep &= node != near
    node, near, sim = node[keep], near[keep], sim[keep]
    order = np.lexsort((near, -sim, node))
    node, near, sim = node[order], near[order], sim[order]
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    keep = rank < k
    node, near, sim = node[keep], near[keep], sim[keep].astype(np.float32)
    if not len(node):
        return
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    ends = pa.array(np.append(starts, len(node)).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [pa.array(node[starts]), pa.ListArray.from_arrays(ends, pa.array(near)), pa.ListArray.from_arrays(ends, pa.array(sim))],
        names=["node", "near", "sim"],
    )


def merged(lists: DataFrame, k: int) -> DataFrame:
    """One row per node from several neighbour lists of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            near, n = _lists(table.column(1))
            sim, _ = _lists(table.column(2))
            yield from best_of(np.repeat(table.column(0).to_numpy(), n), near, sim, k)

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(run, _NEIGHBOURS)


def encode_nodes(distinct: DataFrame) -> DataFrame:
    """``node, code``: the vectors scaled to the longest and lengthened by the
    coordinate that makes all equally long, in half precision."""
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    top = distinct.agg(F.max(squares)).first()[0] or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = _lists(batch.column(1))
            if not batch.num_rows:
                continue
            x = flat.reshape(batch.num_rows, -1) / top**0.5
            extra = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))
            code = np.concatenate([x, extra], axis=1).astype(_NODE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary())], names=["node", "code"])

    return distinct.select("node", "vector").mapInArrow(run, "node long, code binary")


def _fit_trees(sample: np.ndarray, n: int, s: Settings) -> list[list[tuple[np.ndarray, float]]]:
    """Per tree, hyperplanes in heap order: the children of i are 2i+1, 2i+2."""
    depth = 0
    while n >> depth > s.group and len(sample) >> (depth + 1) >= 8:
        depth += 1
    rng = np.random.default_rng(s.seed)
    trees = []
    for _ in range(s.trees):
        planes, parts = [], [np.arange(len(sample))]
        for _ in range(depth):
            below = []
            for p in parts:
                a, b = rng.choice(p, 2, replace=False) if len(p) > 1 else (0, 0)
                normal = (sample[a] - sample[b]).astype(np.float32)
                side = sample[p] @ normal
                at = float(np.median(side)) if len(p) else 0.0
                planes.append((normal, at))
                below += [p[side <= at], p[side > at]]
            parts = below
        trees.append(planes)
    return trees


def _split(x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    stack = [rows]
    while stack:
        p = stack.pop()
        if len(p) <= leaf:
            yield p
            continue
        a, b = rng.choice(p, 2, replace=False)
        order = np.argsort(x[p] @ (x[a] - x[b]), kind="stable")
        stack += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]


def leaf_neighbours(nodes: DataFrame, s: Settings) -> DataFrame:
    """The starting graph: each tree's best neighbours of each node."""
    n = nodes.count()
    size = max(s.sample, 16 * -(-n // s.group))  # trees grow deeper with the rows
    share = min(1.0, size / max(1, n))
    picked = nodes.filter(F.pmod(F.xxhash64("node", F.lit(s.seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = picked.select("code").limit(size + size // 4).collect()
    sample = np.stack([np.frombuffer(r["code"], _NODE) for r in rows]).astype(np.float32) if rows else np.zeros((0, 1), np.float32)
    trees = _fit_trees(sample, n, s)
    depth = (len(trees[0]) + 1).bit_length() - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), _NODE).astype(np.float32)
            for t, planes in enumerate(trees):
                at = np.zeros(len(x), np.int64)
                for _ in range(depth):
                    for i in np.unique(at).tolist():
                        here = np.flatnonzero(at == i)
                        normal, cut = planes[i]
                        at[here] = 2 * i + 1 + (x[here] @ normal > cut)
                part = at + (t << 32)
                yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0), batch.column(1)], names=["part", "node", "code"])

    dealt = staged(nodes.mapInArrow(deal, "part long, node long, code binary"), "leaves")
    sizes = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # trees x leaves rows
    pieces = F.lit(1)
    for part, size in sizes.items():
        if size > 2 * s.group:  # more alike vectors than the trees can part
            pieces = F.when(F.col("part") == part, F.lit(-(-size // s.group))).otherwise(pieces)
    tree = F.shiftright("part", 32)  # other pieces in each tree
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("node", tree), pieces))
    k, leaf, seed = s.neighbours, s.leaf, s.seed

    def near(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy()
        x = np.frombuffer(b"".join(rows["code"]), _NODE).reshape(len(rows), -1).astype(np.float32)
        order = np.argsort(node)
        node, x = node[order], x[order]
        found: list[tuple] = []
        for p in _split(x, np.arange(len(x)), leaf, np.random.default_rng([seed, int(key[0]) & 0xFFFFFFFF, int(key[0]) >> 32])):
            sim = x[p] @ x[p].T
            np.fill_diagonal(sim, -np.inf)
            m = min(k, len(p) - 1)
            if m < 1:
                continue
            top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
            best = np.take_along_axis(sim, top, 1)
            found += zip(node[p].tolist(), list(node[p][top]), list(best))
        return pd.DataFrame(found, columns=["node", "near", "sim"])

    lists = dealt.groupBy("part", "piece").applyInPandas(near, _NEIGHBOURS)
    return merged(lists, k)


def meetings(graph: DataFrame, nodes: DataFrame, full: int) -> DataFrame:
    """``place, node, code, worst``: every node with its code at each of its
    neighbours, and the similarity of its farthest neighbour (if
    it has ``full`` of them; else any other is welcome)."""
    own = graph.join(nodes, "node")
    worst = F.when(F.size("sim") >= full, F.element_at("sim", -1)).otherwise(F.lit(float("-inf")))
    return own.select(F.explode("near").alias("place"), "node", "code", worst.cast("float").alias("worst"))


def descend(graph: DataFrame, nodes: DataFrame, s: Settings, turn: int) -> DataFrame:
    """One round of NN-descent: at every node its neighbours, the nodes that
    chose it and itself are compared. Meetings of over ``block`` are parted by
    a hash of the round and the node."""
    k, block = s.neighbours, s.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, most=16 * block):
            place = table.column(0).to_numpy()
            node, worst = table.column(1).to_numpy(), table.column(3).to_numpy()
            x = _matrix(table.column(2), _NODE).astype(np.float32)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])), len(place))
            out: list[list[np.ndarray]] = [[], [], []]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for a in range(lo, hi, block):
                    b = min(hi, a + block)
                    if b - a < 2:
                        continue
                    sim = x[a:b] @ x[a:b].T
                    np.fill_diagonal(sim, -np.inf)
                    m = min(k, b - a - 1)  # no list is longer
                    top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                    best = np.take_along_axis(sim, top, 1)
                    row, col = np.nonzero(best > worst[a:b, None])
                    out[0].append(node[a + row])
                    out[1].append(node[a + top[row, col]])
                    out[2].append(best[row, col])
            if out[0]:
                # what a task has found for a node goes on as one list
                yield from best_of(*(np.concatenate(c) for c in out), k)

    own = graph.join(nodes, "node")
    worst = F.when(F.size("sim") >= k, F.element_at("sim", -1)).otherwise(F.lit(float("-inf"))).cast("float")
    # a neighbour that chose the node too is there once
    chosen = graph.select(F.col("node").alias("place"), F.explode("near").alias("node"))
    choosing = graph.select(F.explode("near").alias("place"), "node")
    both = chosen.union(choosing).union(graph.select(F.col("node").alias("place"), "node")).distinct()
    met = both.join(own.select("node", "code", worst.alias("worst")), "node").select("place", "node", "code", "worst")
    met = met.repartition("place").sortWithinPartitions("place", F.xxhash64("node", F.lit(turn)))
    return merged(graph.unionByName(met.mapInArrow(run, _NEIGHBOURS)), k)


def changed(old: DataFrame, new: DataFrame) -> float:
    """The share of the neighbours in ``new`` that are not in ``old``."""
    both = new.select("node", "near").join(old.select("node", F.col("near").alias("last")), "node", "left")
    fresh = F.size(F.array_except("near", F.coalesce("last", F.array().cast("array<long>"))))
    row = both.agg(F.sum(fresh).alias("fresh"), F.sum(F.size("near")).alias("all")).first()
    return (row["fresh"] or 0) / max(1, row["all"] or 0)


@dataclass
class Index:
    rows: DataFrame  # id, vector of every row that takes part
    distinct: DataFrame  # node, vector, ids
    nodes: DataFrame  # node, code
    graph: DataFrame  # node, near, sim
    links: DataFrame  # place, ids, codes: who chose the node as a neighbour
    settings: Settings
    copies: int = 21


def build_index(vectors: DataFrame, settings: Settings | None = None, id_col: str = "vec_id", vec_col: str = "embedding", copies: int = 21) -> Index:
    """Indexes every usable row. Tables are stored in the shared folder. Of
    equal vectors the ``copies`` smallest ids can be found, so ``search`` takes
    any ``k`` below it."""
    s = settings or Settings()
    rows = usable(vectors, id_col, vec_col)
    distinct = staged(distinct_vectors(rows, copies), "vectors")
    nodes = staged(encode_nodes(distinct), "codes")
    graph = staged(leaf_neighbours(nodes, s), "graph")
    share, turn = 1.0, 0
    while share > s.settled:
        last, graph = graph, staged(descend(graph, nodes, s, turn), "graph")
        share, turn = changed(last, graph), turn + 1
        drop_staged(last)
    block = s.block

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, most=16 * block):
            place, node = table.column(0).to_numpy(), table.column(1).to_numpy()
            code = _matrix(table.column(2), _NODE)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])), len(place)).tolist()
            spans = [(a, min(hi, a + block)) for lo, hi in zip(cuts[:-1], cuts[1:]) for a in range(lo, hi, block)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(place[a]) for a, _ in spans]), pa.array([node[a:b].tobytes() for a, b in spans], pa.binary()),
                 pa.array([code[a:b].tobytes() for a, b in spans], pa.binary())],
                names=["place", "ids", "codes"],
            )

    at = meetings(graph, nodes, s.neighbours).select("place", "node", "code").repartition("place").sortWithinPartitions("place")
    links = staged(at.mapInArrow(pack, "place long, ids binary, codes binary"), "links")
    return Index(rows, distinct, nodes, graph, links, s, copies)


def _hop(beams: DataFrame, index: Index, expand: int) -> DataFrame:
    """One greedy step: each query's ``expand`` best unexpanded nodes are
    expanded, and its beam keeps the best of old and new. ``beams``: ``query,
    code, near, sim, done`` (the nodes expanded so far) and ``moved`` (did its
    last hop change the beam?); other beams rest."""
    beam = index.settings.beam
    todo = F.slice(F.array_except("near", "done"), 1, expand)  # near is sorted, best first
    beams = beams.withColumn("todo", F.when(F.col("moved"), todo).otherwise(F.slice("done", 1, 0)))
    worst = F.when(F.size("sim") >= beam, F.element_at("sim", -1)).otherwise(F.lit(float("-inf")))
    steps = beams.select(F.explode("todo").alias("place"), "query", "code", worst.cast("float").alias("worst"))
    whole = steps.join(index.links, "place").select("query", "code", "worst", "ids", "codes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for query, code, worst, ids, codes in zip(*batch.columns):
                q = np.frombuffer(code.as_py(), _NODE)[:-1].astype(np.float32)
                node = np.frombuffer(ids.as_py(), np.int64)
                x = np.frombuffer(codes.as_py(), _NODE).reshape(len(node), -1)[:, :-1].astype(np.float32)
                sim = x @ q
                good = np.flatnonzero(sim > worst.as_py())
                out[0].append(np.full(len(good), query.as_py()))
                out[1].append(node[good])
                out[2].append(sim[good])
            if out[0]:
                yield from best_of(*(np.concatenate(c) for c in out), beam)

    found = whole.mapInArrow(compare, _NEIGHBOURS)
    lists = found.union(beams.select("query", "near", "sim"))
    best = merged(lists, beam).withColumnRenamed("node", "query")
    state = beams.select("query", "code", F.array_union("done", "todo").alias("done"), F.col("near").alias("last"), "todo")
    # with nodes left to expand that a smaller hop had no room for, it goes on
    left = (F.size(F.array_except("near", "done")) > 0) & (F.size("todo") == expand)
    moved = (F.size("todo") > 0) & ((F.col("near") != F.col("last")) | left)
    return best.join(state, "query").select("query", "code", "near", "sim", "done", moved.alias("moved"))


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for
    each id in ``queries`` (column ``query_id``; ids that take no part in the
    index, and repeated ones, give nothing more). A query's own id is no
    candidate, its equals are. Fewer than ``k`` candidates are all returned;
    ties go to the smaller id. An id with several vectors asks with each of
    them, and is found by its best. ``k`` must be below the index's ``copies``.
    """
    if k >= index.copies:
        raise ValueError(f"the index was built for k below {index.copies}; build it with copies={k + 1} or more")
    asked = queries.select(F.col("query_id").cast("long")).distinct()
    own = asked.join(index.rows, asked["query_id"] == index.rows["id"]).select("query_id", "vector")
    seats = staged(own.join(index.distinct.select("node", "vector"), "vector").select("query_id", "node").distinct(), "queries")
    start = seats.select("node").distinct().join(index.nodes, "node").join(index.graph, "node", "left")
    empty = F.array().cast("array<long>")
    # the graph's similarities are of the lengthened vectors: its neighbours
    # are where the search begins, and are scored when they are met
    beams = start.select(
        F.col("node").alias("query"), "code", F.coalesce("near", empty).alias("near"),
        F.transform(F.coalesce("near", empty), lambda x: F.lit(-1e30).cast("float")).alias("sim"), empty.alias("done"),
        F.lit(True).alias("moved"),
    )
    beams = staged(beams, "beams")
    hops, turn = index.settings.hops, 0
    while turn == 0 or not beams.filter("moved").isEmpty():
        last, beams = beams, staged(_hop(beams, index, hops[min(turn, len(hops) - 1)]), "beams")
        turn += 1
        drop_staged(last)
    first = start.select(F.col("node").alias("query"), F.coalesce("near", empty).alias("seeds"))
    met = F.coalesce("near", empty)  # a vector without neighbours has no beam left
    near = F.array_distinct(F.concat(F.array(F.col("query")), F.slice(met, 1, 3 * k), F.slice("seeds", 1, k)))
    pairs = first.join(beams.select("query", "near"), "query", "left").select(F.col("query").alias("node"), F.explode(near).alias("other"))
    mine = index.distinct.select("node", F.col("vector").alias("a"))
    yours = index.distinct.select(F.col("node").alias("other"), F.col("vector").alias("b"), "ids")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    scored = pairs.join(mine, "node").join(yours, "other").select("node", dot.alias("score"), "ids")
    rows = seats.join(scored, "node").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
