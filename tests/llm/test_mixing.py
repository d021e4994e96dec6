from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clickweave.llm import mixing
from clickweave.llm.queries import all_oracles, op5_mixing
from tests.compare import connect, duck_bag, spark_bag


def plain_targets(sizes):
    """Share by weight, cut off, share again, until nothing is cut off."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, rest = {}, 1.5 * sum(sizes.values()), set(names)
    while rest:
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in rest}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            rest.discard(s)
        left -= sum(target[s] for s in over)
    return target


def test_oracle(spark, oracle_dir):
    assert spark_bag(op5_mixing(spark, oracle_dir)) == duck_bag(connect(oracle_dir), all_oracles()["op5_mixing"])


def test_words_come_near_the_targets(spark, oracle_dir):
    rows = op5_mixing(spark, oracle_dir).collect()
    assert rows == op5_mixing(spark, oracle_dir).collect() or sorted(rows) == sorted(op5_mixing(spark, oracle_dir).collect())
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{oracle_dir}/documents.parquet").collect()}
    taken, size, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        size[s] += r.size
        largest[s] = max(largest[s], r.size)
        target[s] = r.target
        assert size[s] <= r.source_size
    assert target == pytest.approx(plain_targets(size))
    for s in taken:
        assert abs(taken[s] - target[s]) <= 1.5 * largest[s]


def test_odd_rows(spark):
    rows = [(1, "a b", None, 7), (2, None, "x", 7), (3, "", "y", 7), (4, "c", "y", 7), (4, "c", "y", 7), (None, "d e f", "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_copies(docs).collect()
    assert len(got) == 6
    sizes = {None: 2, "x": 0, "y": 2, "": 3}
    assert {r.source: r.target for r in got} == pytest.approx(plain_targets(sizes))
    assert all(r.copies == 2 for r in got if r.target == 2 * r.source_size and r.target > 0)
    assert mixing.mix_copies(docs.limit(0)).collect() == []
    nothing = mixing.mix_copies(docs.where(F.col("doc_id") == 3)).collect()
    assert [(r.size, r.target, r.copies) for r in nothing] == [(0, 0.0, 0)]
