"""Exact top-k search by inner product with cover trees over queries and data.

Data and queries are dealt into blocks of bounded size, and each block is indexed once: a tree of centres whose covering radius halves
from level to level. For a pair of blocks both trees are walked together. A pair of nodes can score at most
``<a, b> + |a| rb + |b| ra + ra rb`` (centres a and b, radii ra and rb); where that is below the worst kth score within the
query node the pair is pruned, all below it included. The best k of each block pair are merged per query. Results are exact.

Rows of the same id and vector are one entry that knows its number of rows. Equal vectors are searched for once, and of equal data
vectors only the k + 1 smallest ids can be among the k best, so a vector that a large share of the rows has is one entry. All limits
count entries, of which the query's own id has one; a query whose id has several vectors is searched for by itself, without
the entries of its id. The rows of an entry are counted again at the end.

Components become floor(scale * x). Vectors that are null or hold a null or non-finite component, and rows without an id, take
no part. Shorter vectors count as filled up with zeros. Scores must fit into a long. Ties go to the smaller id. A repeated row
is a candidate like any other, but a query never gets a row of its own id. An empty table gives an empty result. Columns other
than the id and the vector are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of data, and in a block of queries.
BLOCK = 4096
QUERY_BLOCK = 1024
LEAF = 64


class CoverTree(NamedTuple):
    """Points in tree order; node i covers points first[i] to end[i] within radius[i] of centre[i]; its children are kids[i]."""

    points: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    end: np.ndarray
    kids: list[list[int]]


def build_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """Each node's points are covered greedily by balls of half its radius, until ``leaf`` or fewer are left."""
    points = points.astype(np.float64)
    order = np.arange(len(points))
    centre, radius, first, end, kids = [], [], [], [], []

    def add(start: int, stop: int, middle: np.ndarray) -> int:
        gaps = np.sqrt(((points[order[start:stop]] - middle) ** 2).sum(1))
        centre.append(middle)
        radius.append(float(gaps.max(initial=0.0)) * (1 + 1e-12))
        first.append(start)
        end.append(stop)
        kids.append([])
        return len(centre) - 1

    todo = [add(0, len(points), points.mean(0))] if len(points) else []
    while todo:
        node = todo.pop()
        start, stop = first[node], end[node]
        if stop - start <= leaf or radius[node] == 0.0:
            continue
        own = order[start:stop]
        half, ball = radius[node] / 2, np.full(len(own), -1)
        middles = []
        while (free := np.flatnonzero(ball < 0)).size:
            middle = points[own[free[0]]]
            near = ((points[own[free]] - middle) ** 2).sum(1) <= half * half
            ball[free[near]] = len(middles)
            middles.append(middle)
        order[start:stop] = own[np.argsort(ball, kind="stable")]
        sizes = np.bincount(ball, minlength=len(middles))
        # Balls of few points are gathered into one leaf, covered from their mean.
        at, small = start, start
        for size, middle in zip(sizes, middles, strict=True):
            if size > leaf // 2:
                if at > small:
                    kids[node].append(add(small, at, points[order[small:at]].mean(0)))
                kids[node].append(add(at, at + size, middle))
                small = at + size
            elif at + size - small > leaf:
                kids[node].append(add(small, at, points[order[small:at]].mean(0)))
                small = at
            at += size
        if stop > small:
            kids[node].append(add(small, stop, points[order[small:stop]].mean(0)))
        if len(kids[node]) > 1:
            todo += kids[node]
        else:
            kids[node] = []
    return CoverTree(points[order], order, np.array(centre), np.array(radius), np.array(first), np.array(end), kids)


def dual_tree_search(queries: CoverTree, data: CoverTree, data_ids: np.ndarray, k: int,
                     barred: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, data id, score) of the k best of every query. Positions are those before the tree was built. ``barred``: for
    each query the first data id that it must not get, and the one after the last."""
    n = len(queries.points)
    if not n or not len(data.points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = data_ids[data.order]
    exact = np.abs(queries.points).max(initial=0) * np.abs(data.points).max(initial=0) * queries.points.shape[1] < 2**53
    whole_queries, whole_data = (queries.points, data.points) if exact else (queries.points.astype(np.int64), data.points.astype(np.int64))
    none = np.iinfo(np.int64).min
    barred_from, barred_to = (b[queries.order] for b in barred) if barred else (None, None)
    best, best_ids = np.full((n, k), none), np.full((n, k), np.iinfo(np.int64).max)
    query_norm, data_norm = (np.sqrt((t.centre ** 2).sum(1)) for t in (queries, data))

    def most(query: int, nodes: np.ndarray) -> np.ndarray:
        reach = query_norm[query] * data.radius[nodes] + queries.radius[query] * (data_norm[nodes] + data.radius[nodes])
        bound = data.centre[nodes] @ queries.centre[query] + reach
        return bound + 1e-9 * (np.abs(bound) + reach + 1)

    def worst(query: int) -> int:
        return best[queries.first[query]:queries.end[query], -1].min()

    def compare(query: int, node: int) -> None:
        q, d = slice(queries.first[query], queries.end[query]), slice(data.first[node], data.end[node])
        scores = (whole_queries[q] @ whole_data[d].T).astype(np.int64)
        useful = np.flatnonzero((scores >= best[q, -1][:, None]).any(0))
        if not useful.size:
            return
        scores, names = scores[:, useful], np.broadcast_to(ids[d][useful], (scores.shape[0], useful.size))
        if barred is not None:
            out = (names >= barred_from[q][:, None]) & (names < barred_to[q][:, None])
            scores, names = np.where(out, none, scores), np.where(out, np.iinfo(np.int64).max, names)
        scores, names = np.concatenate([best[q], scores], 1), np.concatenate([best_ids[q], names], 1)
        kept = np.lexsort((names, ~scores), axis=1)[:, :k]  # ~ turns the order around without overflow
        best[q], best_ids[q] = np.take_along_axis(scores, kept, 1), np.take_along_axis(names, kept, 1)

    def walk(query: int, nodes: np.ndarray) -> None:
        """Below a query node, look at these data nodes; those that cannot matter are left out for all queries below."""
        nodes = nodes[most(query, nodes) >= worst(query)]
        if not nodes.size:
            return
        if queries.kids[query]:
            opened = np.array([x for node in nodes for x in (data.kids[node] or [node])])
            for child in queries.kids[query]:
                walk(child, opened)
            return
        heap = [(-bound, node) for bound, node in zip(most(query, nodes).tolist(), nodes.tolist(), strict=True)]
        heapq.heapify(heap)
        while heap and -heap[0][0] >= worst(query):
            _, node = heapq.heappop(heap)
            if data.kids[node]:
                below = np.array(data.kids[node])
                for bound, child in zip(most(query, below).tolist(), below.tolist(), strict=True):
                    heapq.heappush(heap, (-bound, child))
            else:
                compare(query, node)

    walk(0, np.array([0]))
    real = best_ids != np.iinfo(np.int64).max
    return np.repeat(queries.order, real.sum(1)), best_ids[real], best[real]


def whole_vectors(vectors: DataFrame, scale: int, id_column: str, vector: str) -> DataFrame:
    """vec_id and e (array of long) of the rows that take part."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    e = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    return vectors.where(F.col(id_column).isNotNull() & x.isNotNull()).where(~bad).select(F.col(id_column).cast("long").alias("vec_id"), e.alias("e"))


def _blocks(rows: DataFrame, name: str, size: int, n: int, width: int) -> DataFrame:
    """A row per block: its number, ids, notes and tree. ``rows`` holds vec_id, e and note (long), no two with the same vec_id
    and e; about ``size`` rows go into each block. Ids ascend."""

    def index(key, table):
        table = table.sort_by("vec_id")
        ids, notes = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "note"))
        points = np.zeros((len(ids), width))
        for i, e in enumerate(table.column("e").to_pylist()):
            points[i, :len(e)] = e
        columns = [pa.array([x], pa.binary()) for x in (ids.tobytes(), notes.tobytes(), pickle.dumps(tuple(build_tree(points))))]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *columns], names=[name, f"{name}_ids", f"{name}_notes", f"{name}_tree"])

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "e"), F.lit(max(1, -(-n // size)))))
    return dealt.groupBy(name).applyInArrow(index, f"{name} long, {name}_ids binary, {name}_notes binary, {name}_tree binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_column: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """Rows query_id, rank (from 1), vec_id, score: the k best other rows of every row for which ``is_query`` (over vec_id) holds."""
    whole = whole_vectors(vectors, scale, id_column, vector)
    by_vector = Window.partitionBy("e").orderBy("vec_id")
    entries = whole.groupBy("vec_id", "e").agg(F.count(F.lit(1)).alias("note"))
    data = entries.withColumn("at", F.row_number().over(by_vector)).where(F.col("at") <= k + 1).drop("at")
    # slot: 0 for the only vector of an id, else a number from 1 for each of them.
    of_id = Window.partitionBy("vec_id")
    slot = F.when(F.count(F.lit(1)).over(of_id) > 1, F.row_number().over(of_id.orderBy("e"))).otherwise(0).cast("long")
    asked = whole.where(is_query).select("vec_id", "e").distinct().select("vec_id", "e", slot.alias("slot"))
    shared = asked.where(F.col("slot") == 0).groupBy("e").agg(F.min("vec_id").alias("leader"))
    leaders = shared.select(F.col("leader").alias("vec_id"), "e", F.lit(0).cast("long").alias("note")).union(
        asked.where(F.col("slot") > 0).select("vec_id", "e", F.col("slot").alias("note")))
    sizes = whole.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("e")).alias("width")).first()
    if not sizes.n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_blocks = max(1, -(-sizes.n // BLOCK))
    data_blocks = _blocks(data, "d", BLOCK, sizes.n, sizes.width or 1)
    query_blocks = _blocks(leaders, "q", QUERY_BLOCK, leaders.count(), sizes.width or 1)

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                query_ids, slots, data_ids, copies = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "q_notes", "d_ids", "d_notes"))
                query_tree, data_tree = (CoverTree(*pickle.loads(row[f"{x}_tree"])) for x in "qd")
                # Entries go by their place in the order of ids, which tells those of the same id apart.
                barred = tuple(np.where(slots > 0, np.searchsorted(data_ids, query_ids, side), 0) for side in ("left", "right"))
                at, found, score = dual_tree_search(query_tree, data_tree, np.arange(len(data_ids)), k + 1, barred)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query_ids[at], slots[at], data_ids[found], copies[found], score)],
                                                 names=["leader", "slot", "vec_id", "copies", "score"])

    pairs = query_blocks.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).join(data_blocks, "d")
    found = pairs.select("q_ids", "q_notes", "q_tree", "d_ids", "d_notes", "d_tree").repartition(F.xxhash64("q_ids", "d_ids")).mapInArrow(
        search, "leader long, slot long, vec_id long, copies long, score long")
    best = Window.partitionBy("leader", "slot").orderBy(F.col("score").desc(), "vec_id")
    merged = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at")
    leader_of = asked.where(F.col("slot") == 0).join(shared, "e").select(F.col("vec_id").alias("query_id"), "leader", "slot").union(
        asked.where(F.col("slot") > 0).select("vec_id", F.col("vec_id").alias("leader"), "slot"))
    each = leader_of.join(merged, ["leader", "slot"]).where(F.col("query_id") != F.col("vec_id"))
    before = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id").rowsBetween(Window.unboundedPreceding, -1)
    counted = each.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0))).where(F.col("before") < k)
    rank = F.explode(F.sequence((F.col("before") + 1).cast("int"), F.least(F.col("before") + F.col("copies"), F.lit(k)).cast("int"))).alias("rank")
    return counted.select("query_id", rank, "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
