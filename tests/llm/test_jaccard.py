from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clickweave.llm import bytescan, jaccard
from clickweave.llm.graph import connected_components
from clickweave.llm.queries import op1_jaccard


def plain_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def plain_components(docs):
    """doc_id -> (set size, smallest doc_id linked), by trying every pair of sets that share a shingle."""
    sets = [(doc_id, plain_set(text)) for doc_id, text in docs]
    root = {doc_id: doc_id for doc_id, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    holders, by_set = defaultdict(list), {}
    for doc_id, s in sets:
        if s and s in by_set:
            join(by_set[s], doc_id)
        elif s:
            by_set[s] = doc_id
            for shingle in s:
                holders[shingle].append((doc_id, s))
    for doc_id, s in sets:
        partners = {other: t for shingle in s for other, t in holders[shingle] if other < doc_id}
        for other, t in partners.items():
            common = len(s & t)
            if 100 * common >= 80 * (len(s) + len(t) - common):
                join(other, doc_id)
    return {doc_id: (len(s), find(doc_id)) for doc_id, s in sets}


def edited(words, n, rng, vocabulary):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at:at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
    return words


def check(spark, docs, frame=None):
    frame = frame if frame is not None else spark.createDataFrame(docs, "doc_id long, text string")
    rows = jaccard.link_components(frame).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(docs) and got == plain_components(docs)
    return got


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_of_all_sizes(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for size in [*range(1, 30), 45, 64, 80, 100, 160, 250, 400, 700]:
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(6):
            docs.append(" ".join(edited(base, rng.randrange(0, 2 + size // 40), rng, vocabulary)).upper())
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    got = check(spark, docs)
    assert len({c for _, c in got.values()}) < len(docs)


def test_popular_text_and_passage(spark):
    """Hundreds of near copies of one text, and a passage that hundreds of other texts hold: both make hot keys."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    docs = [" ".join(edited(base, rng.randrange(0, 4), rng, vocabulary)) for _ in range(250)]
    docs += [" ".join([rng.choice(vocabulary) for _ in range(20)] + passage + [rng.choice(vocabulary) for _ in range(20)]) for _ in range(250)]
    check(spark, list(enumerate(docs)))


def test_whole_table(spark, small_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_jaccard(spark, small_dir).collect()}
    assert got == plain_components(docs)


def test_sets_with_too_few_blocks_are_joined_on_their_shingles(spark):
    assert jaccard.block_keys(np.arange(4, dtype=np.uint64), 2, 1) is None  # all in the first block
    texts = [f"a b c d e f g h i {x}" for x in "jklm"] + ["a b c d e f g h i j k", "q r s t u v w x y z"]
    sets = [plain_set(text) for text in texts]
    chunk = next(bytescan.chunks(pa.array([t.encode() for t in texts])))
    nodes = [jaccard.set_id(s) for s in jaccard.shingle_sets(chunk)]
    frame = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    classes = spark.createDataFrame([(n, -7 - (jaccard._UNLUCKY if i in (0, 5) else 0)) for i, n in enumerate(nodes)], "node long, info long")
    got = {(r.a, r.b) for r in jaccard._pairs_of_unlucky(frame, classes).collect()}
    assert got == {(nodes[0], nodes[i]) for i in range(1, 6) if sets[0] & sets[i]} and len(got) == 4
    assert jaccard._pairs_of_unlucky(frame, classes.where("info > -100")) is None


def test_blocks_hold_the_bound():
    rng = np.random.default_rng(0)
    for n in (4, 9, 31, 64, 333):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            apart = jaccard.most_apart(n, n * 5 // 4)
            band = n.bit_length() - 1
            gone = int(rng.integers(0, apart + 1))
            b = np.unique(np.concatenate([a[:len(a) - gone // 2], rng.integers(0, 2**63, gone - gone // 2, dtype=np.uint64)]))
            if (len(b).bit_length() - 1) != band:
                continue
            x, y = jaccard.block_keys(a, band, apart), jaccard.block_keys(b, band, jaccard.most_apart(len(b), len(b) * 5 // 4))
            if x and y:
                assert set(x[0].tolist()) & set(y[0].tolist())
            differing = np.bitwise_count(np.bitwise_xor(*(np.frombuffer(jaccard.dense_sketch(x), np.uint64) for x in (a, b)))).sum()
            assert differing <= gone


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A B"), (6, "a b c d e f"), (7, "x" * 100_000), (8, "é É")]
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, node int, key string")
    check(spark, docs, frame)
    assert jaccard.link_components(frame.limit(0)).collect() == []
    twice = jaccard.link_components(frame.union(frame)).collect()
    assert sorted(twice) == sorted(jaccard.link_components(frame).collect() * 2)
    lone = jaccard.link_components(spark.createDataFrame([(None, "a b"), (None, None), (3, "a b")], "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, lone))) == ["(3, 1, 3)", "(None, 0, None)", "(None, 1, None)"]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(220)]
    edges += [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
