from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickweave.llm import topk
from clickweave.llm.queries import all_oracles, op8_topk
from tests.compare import connect, duck_bag, spark_bag


def plain(queries, data, ids, k):
    scores = queries.astype(np.int64) @ data.astype(np.int64).T
    return [[(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s))[:k]] for s in scores]


@pytest.mark.parametrize("seed", range(12))
def test_dual_tree_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, m, width = int(rng.integers(1, 900)), int(rng.integers(1, 300)), int(rng.integers(1, 20))
    middles = rng.integers(-40, 40, (6, width))
    data = middles[rng.integers(0, 6, n)] + rng.integers(-3, 4, (n, width)) * (seed % 3)
    queries = middles[rng.integers(0, 6, m)] + rng.integers(-3, 4, (m, width))
    ids = rng.permutation(10 * n)[:n].astype(np.int64)
    at, found, score = topk.dual_tree_search(topk.build_tree(queries, 8), topk.build_tree(data, 8), ids, 7)
    got = [[] for _ in range(m)]
    for q, i, s in zip(at, found, score):
        got[q].append((int(i), int(s)))
    assert got == plain(queries, data, ids, 7)


def test_tree_covers_its_points():
    points = np.random.default_rng(1).integers(-50, 50, (700, 5))
    tree = topk.build_tree(points, 16)
    assert sorted(tree.order) == list(range(700))
    for i in range(len(tree.radius)):
        inside = tree.points[tree.first[i]:tree.end[i]]
        assert (np.sqrt(((inside - tree.centre[i]) ** 2).sum(1)) <= tree.radius[i] + 1e-9).all()
        if tree.kids[i]:
            spans = [(tree.first[x], tree.end[x]) for x in tree.kids[i]]
            assert spans[0][0] == tree.first[i] and spans[-1][1] == tree.end[i]
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_far_pairs_are_pruned():
    rng = np.random.default_rng(2)
    middles = np.eye(8) * 1000
    data = np.concatenate([middles[i] + rng.integers(-2, 3, (200, 8)) for i in range(8)])
    tree, queries = topk.build_tree(data), topk.build_tree(data[:64])
    assert len(tree.kids[0]) > 1
    at, found, _ = topk.dual_tree_search(queries, tree, np.arange(len(data)), 5)
    assert (found < 200).all() and len(at) == 320


def test_oracle(spark, oracle_dir):
    assert spark_bag(op8_topk(spark, oracle_dir)) == duck_bag(connect(oracle_dir), all_oracles()["op8_topk"])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, 2.0], 1),
            (6, [1.0, 2.0], 1), (7, [-1.0], 1), (None, [9.0, 9.0], 1), (20, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (40, [0.0, 0.5], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    query = F.col("vec_id") % 20 == 0
    got = sorted(topk.top_k(frame, query, 3, 1).collect())
    of = lambda q: [(r.vec_id, r.score) for r in got if r.query_id == q]
    assert of(0) == [(5, 5), (6, 5), (20, 5)] and of(20) == [(0, 5), (5, 5), (6, 5)]
    assert of(40) == [(0, 0), (5, 0), (6, 0)]
    assert len(got) == 9
    assert topk.top_k(frame.limit(0), query).collect() == []
    assert topk.top_k(frame.where("vec_id is null or vec_id in (1, 3)"), query).collect() == []
    assert topk.top_k(frame.where("vec_id = 0"), query).collect() == []


def test_one_vector_held_by_most_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [3.0] * 4 if i % 3 else rng.integers(-9, 9, 4).astype(float).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(topk.top_k(frame, F.col("vec_id") % 20 == 0, 5, 1).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    points, ids = np.array([v for _, v in rows]), np.arange(600)
    for q in range(0, 600, 20):
        others = ids != q
        assert got[q] == plain(points[q:q + 1], points[others], ids[others], 5)[0]


def test_repeated_smallest_id(spark):
    """The query's id holds more rows than the limit, all ahead of the others."""
    rows = [(0, [2.0])] * 9 + [(5, [2.0]), (6, [2.0]), (20, [2.0]), (7, [1.0]), (7, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(topk.top_k(frame, F.col("vec_id") % 20 == 0, 5, 1).collect())
    assert [tuple(r) for r in got] == [(0, 1, 5, 4), (0, 2, 6, 4), (0, 3, 20, 4), (0, 4, 7, 2), (0, 5, 7, 2)] + [(20, i, 0, 4) for i in range(1, 6)]


@pytest.mark.parametrize("seed", range(3))
def test_ids_with_several_vectors_and_repeated_rows(spark, seed):
    rng = np.random.default_rng(seed)
    ids = np.where(rng.random(300) < 0.4, 0, rng.integers(0, 60, 300))
    points = rng.integers(-3, 4, (300, 2)).astype(float)
    frame = spark.createDataFrame(list(zip(ids.tolist(), points.tolist())), "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(topk.top_k(frame, F.col("vec_id") % 20 == 0, 7, 1).collect()):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in {i for i in ids.tolist() if i % 20 == 0}:
        asked = np.unique(points[ids == q], axis=0)
        best = sorted((-int(s), int(i)) for v in asked for i, s in zip(ids[ids != q], points[ids != q] @ v))[:7]
        assert got[q] == [(rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
