from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from clickweave.llm import neardup
from clickweave.llm.queries import op11_neardup


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def near(prints):
    """Pairs of places of fingerprints at most three bits apart."""
    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 3).tolist():
            yield i, i + 1 + j


def classes(docs):
    """Rows (doc_id, fingerprint, component_id), by comparing all with all."""
    prints = [fingerprint(text) for _, text in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in near(prints):
        root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        known = least.get(find(i))
        least[find(i)] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    return [(doc_id, f"{prints[i]:016x}", least[find(i)]) for i, (doc_id, _) in enumerate(docs)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def test_whole_table(spark, oracle_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{oracle_dir}/documents.parquet").collect()]
    got = op11_neardup(spark, oracle_dir).collect()
    assert order((r.doc_id, r.fingerprint, r.component_id) for r in got) == order(classes(docs))
    assert sum(r.doc_id != r.component_id for r in got) > 10


def clusters(seed, n_clusters, size, turning):
    """Fingerprints around a few centres that differ in few places only."""
    rng = random.Random(seed)
    found = set()
    for _ in range(n_clusters):
        centre, places = rng.getrandbits(64), rng.sample(range(64), turning)
        for _ in range(size):
            found.add(centre ^ sum(1 << b for b in places if rng.random() < 0.3))
    return sorted(found)


@pytest.mark.parametrize("hot", [0, 3, 20, neardup.HOT])
@pytest.mark.parametrize("turning", [6, 11, 40])
def test_no_pair_is_lost_at_any_depth(spark, hot, turning):
    prints = clusters(turning, 3, 120, turning) + [0, 1, (1 << 64) - 1, 1 << 63, (1 << 63) | 1, 0xFFFF << 16, 0xFFFF << 48]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = neardup.near_pairs(spark.createDataFrame(signed + signed[:5], "fingerprint long"), hot).collect()
    want = {tuple(sorted((signed[i][0], signed[j][0]))) for i, j in near(prints)}
    assert len(got) == len(want) and {(r.b, r.a) for r in got} == want


def test_work_of_a_crowded_entry_grows_in_proportion(spark):
    """Fingerprints that all share a segment: twice as many, about twice the rows compared, not four times."""
    rng = random.Random(8)
    counted = []
    for n in (2000, 4000):
        prints = [((rng.getrandbits(31) << 32) | 12345,) for _ in range(n)]
        pairs = neardup.near_pairs(spark.createDataFrame(prints, "fingerprint long"), hot=64)
        pairs.collect()
        counted.append(_join_rows(pairs))
    assert counted[1] < 3 * counted[0]


def _join_rows(df):
    """Rows that went into tests on complete distances, over all joins of the plan that ran."""
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        if "QueryStage" in name:
            plans.append(plan.plan())
        if "Join" in name or name == "Filter":
            total += plan.metrics().apply("numOutputRows").value() if plan.metrics().contains("numOutputRows") else 0
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return total


def test_odd_rows(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(300_000))
    docs = [(4, None), (2, ""), (3, " \t\n"), (9, "One two"), (8, "one  TWO"), (7, "x"), (6, "Ünïcode   \U0001f600 wörds É"), (5, long_text),
            (1, long_text + " end"), (None, "one two"), (None, "alone here now"), (11, "a" * 100_000), (12, "É é Z z")]
    rows = [(i, t, 1, "x", "y") for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int, fingerprint string, words string")
    got = [(r.doc_id, neardup_text(r.fingerprint), r.component_id) for r in neardup.near_duplicates(frame).collect()]
    assert order(got) == order(classes(docs))
    assert {r[0]: r[2] for r in got}[4] == 2 and {r[0]: r[2] for r in got}[5] == 1
    twice = [(r.doc_id, neardup_text(r.fingerprint), r.component_id) for r in neardup.near_duplicates(frame.union(frame)).collect()]
    assert order(twice) == order(classes(docs + docs))
    assert neardup.near_duplicates(frame.limit(0)).collect() == []


def neardup_text(value):
    return f"{value & (1 << 64) - 1:016x}"
