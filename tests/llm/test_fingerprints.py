from __future__ import annotations

import hashlib
import random
import re

import pytest

from clickweave.llm import fingerprints
from clickweave.llm.queries import op10_fingerprints


def check_rows(rows, docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    want, own = [], {}
    for k, (doc_id, text) in enumerate(docs):
        behind = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + behind[:cut]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=key) == sorted(want, key=key)
    same = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
    prints = {r.doc_id: r.fingerprint for r in rows}
    for k, (doc_id, text) in enumerate(docs):
        own.setdefault(" ".join(re.findall("[^\x20\x09-\x0d]+", text)), set()).add(prints[doc_id])
    assert all(len(found) == 1 for found in own.values())
    following = {doc_id: docs[(k + 1) % len(docs)][0] for k, (doc_id, _) in enumerate(docs)}
    for r in rows:
        assert r.near_edited == pytest.approx(same(r.fingerprint, r.edited_fingerprint))
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 32
        if len(following) == len(docs):
            assert r.near_next == pytest.approx(same(r.fingerprint, prints[following[r.doc_id]]))


def test_whole_table(spark, oracle_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{oracle_dir}/documents.parquet").collect()]
    rows = op10_fingerprints(spark, oracle_dir).collect()
    check_rows(rows, docs)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)


def test_scattered_ids(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(12))))
            for i in {rng.randrange(-2**62, 2**62) for _ in range(300)} | set(range(500)) | {-2**63, 2**63 - 1}]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check_rows(fingerprints.edited_fingerprints(frame).collect(), docs)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t "), (4, "x" * 2000), (9, "é ü"), (None, "last one here")]
    frame = spark.createDataFrame([(i, t, 1, "n") for i, t in docs], "doc_id long, text string, at int, range string")
    check_rows(fingerprints.edited_fingerprints(frame).collect(), docs)
    assert fingerprints.edited_fingerprints(frame.limit(0)).collect() == []
    one = fingerprints.edited_fingerprints(frame.where("doc_id = 9")).collect()
    check_rows(one, [(9, "é ü")])
    twice = fingerprints.edited_fingerprints(frame.union(frame)).collect()
    assert len(twice) == 12 and len({r.fingerprint for r in twice}) == 4


def test_bit_votes(spark):
    rows = [(1, "aaaa bbbbbbb aaaa c"), (2, "zz")]
    got = {r.doc_id: (r.h0, r.h1) for r in fingerprints.simhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    from pyspark.sql import functions as F
    words = {"aaaa": 2, "bbbbbbb": 5, "c": 1, "zz": 1}
    hashes = {r.w: (r.a, r.b) for r in spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", F.xxhash64("w").alias("a"), F.xxhash64("w", F.lit(1)).alias("b")).collect()}
    for doc_id, text in rows:
        for half in (0, 1):
            total = sum(words[w] for w in text.split())
            bits = sum(1 << i for i in range(64) if 2 * sum(words[w] * (hashes[w][half] >> i & 1) for w in text.split()) > total)
            assert got[doc_id][half] & (2**64 - 1) == bits


def test_all_near_pairs_are_found(spark):
    rng = random.Random(4)
    prints = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(60)]
    for h0, h1 in list(prints):
        for _ in range(4):
            flips = [rng.randrange(128) for _ in range(rng.randrange(1, 6))]
            value = h0 | h1 << 64
            for bit in flips:
                value ^= 1 << bit
            prints.append((value & (2**64 - 1), value >> 64))
    signed = [tuple(h - 2**64 if h >= 2**63 else h for h in pair) for pair in prints]
    frame = spark.createDataFrame(signed + signed[:9], "h0 long, h1 long")
    far = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))
    distinct = sorted(set(signed))
    want = {(a, b, far(a, b)) for i, a in enumerate(distinct) for b in distinct[i + 1:] if far(a, b) <= 3}
    got = {((r.a0, r.a1), (r.b0, r.b1), r.distance) for r in fingerprints.near_fingerprints(frame, 3).collect()}
    assert got == want and len(want) > 50
