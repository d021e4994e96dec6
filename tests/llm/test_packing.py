from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from clickweave.llm import packing
from clickweave.llm.queries import op6_packing, tokenizer_file

FILE = "word_bpe_49k.json"


def check_plan(counts, capacity, plan):
    used = defaultdict(int)
    for filling, times in plan:
        assert times > 0 and sum(size * n for size, n in filling.items()) <= capacity
        for size, n in filling.items():
            used[size] += n * times
    assert dict(used) == {size: n for size, n in counts.items() if n}
    return sum(times for _, times in plan)


def fewest(sizes, capacity):
    """Fewest bins by trying all placements."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= sizes[i]}):
            rest = list(bins)
            rest.remove(room)
            place(i + 1, rest + [room - sizes[i]])
        place(i + 1, bins + [capacity - sizes[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_small_plans_are_near_the_fewest(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(0, 9))), reverse=True)
    counts = {s: sizes.count(s) for s in sizes}
    assert check_plan(counts, 20, packing.pack_lengths(counts, 20)) <= fewest(sizes, 20) + (len(sizes) > 4)


@pytest.mark.parametrize("seed", range(60))
def test_dominating_sets_keep_the_fewest(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(3, 21) for _ in range(rng.randrange(1, 9))]
    left = packing._Left({s: sizes.count(s) for s in sizes})
    largest = max(sizes)
    filling = packing.dominating_set(left, largest, 20)
    if filling:
        rest = list(sizes)
        for size, n in filling.items():
            for _ in range(n):
                rest.remove(size)
        assert 1 + fewest(sorted(rest, reverse=True), 20) == fewest(sorted(sizes, reverse=True), 20)


def test_large_plan_is_near_the_bound():
    rng = random.Random(7)
    counts = defaultdict(int)
    for _ in range(50_000):
        counts[min(2048, int(rng.lognormvariate(6, 1)) + 1)] += 1
    bins = check_plan(counts, 2048, packing.pack_lengths(dict(counts), 2048))
    assert bins <= 1.01 * math.ceil(sum(s * n for s, n in counts.items()) / 2048)


def check_rows(rows, docs, capacity):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_file(FILE))
    want = {}
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for i, start in enumerate(range(0, len(ids), capacity)):
            piece = np.array(ids[start:start + capacity], "<u4").tobytes()
            want[doc_id, i] = (start, len(piece) // 4, zlib.crc32(piece))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_whole_table(spark, oracle_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{oracle_dir}/documents.parquet").collect()]
    rows = op6_packing(spark, oracle_dir).collect()
    n = check_rows(rows, docs, 2048)
    assert n <= 1.02 * math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "It's 2024!\x1c ΣΑΣ <|endoftext|>x é ́a"), (4, "word " * 50), (5, "x" * 3000)]
    frame = spark.createDataFrame([(i, t, "piece") for i, t in docs], "doc_id long, text string, piece string")
    check_rows(packing.pack_documents(frame, tokenizer_file(FILE), 16).collect(), docs, 16)
    assert packing.pack_documents(frame.limit(0), tokenizer_file(FILE)).collect() == []
    twice = packing.pack_documents(frame.union(frame), tokenizer_file(FILE), 16).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice) == 2 * packing.token_pieces(frame, tokenizer_file(FILE), 16).count()


def plain_best_fit(counts, capacity):
    """Rooms left when each document goes to the fullest sequence that takes it."""
    rooms = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [(room, i) for i, room in enumerate(rooms) if room >= size]
            if fits:
                rooms[min(fits)[1]] -= size
            else:
                rooms.append(capacity - size)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_groups_fill_as_single_documents_do(seed):
    rng = random.Random(seed)
    counts = defaultdict(int)
    for _ in range(rng.randrange(1, 60)):
        counts[rng.randrange(1, rng.choice([8, 21]))] += 1
    plan = list(packing.best_fit(counts, 20))
    check_plan(counts, 20, plan)
    assert sorted(20 - sum(size * n for size, n in filling.items()) for filling, times in plan for _ in range(times)) == plain_best_fit(counts, 20)


def test_plan_does_not_grow_with_the_counts():
    assert packing.pack_lengths({1100: 10**6, 600: 10**6}) == [({1100: 1, 600: 1}, 10**6)]
    rng = random.Random(11)
    counts = {size: rng.randrange(1, 1000) for size in range(1, 2049)}
    small, large = (packing.pack_lengths({size: n * times for size, n in counts.items()}) for times in (1, 10**6))
    check_plan({size: n * 10**6 for size, n in counts.items()}, 2048, large)
    for plan in (small, large):
        assert len(plan) <= 5 * 2048


def test_long_texts_in_stretches(spark):
    text = b"  ab cd\n" + b"x" * 50 + b" y" * 40
    for size in (1, 3, 10, 49, 1000):
        cut = list(packing.stretches(text, size))
        assert b"".join(cut) == text and all(stretch[:1] in b" \n" for stretch in cut[1:])
    long = [(1, "It's a word, 2024! " * 120_000), (2, "é" * 700_000), (3, None), (4, "a b")]
    frame = spark.createDataFrame(long, "doc_id long, text string")
    check_rows(packing.pack_documents(frame, tokenizer_file(FILE)).collect(), long, 2048)


def test_lengths_in_many_parts(spark):
    docs = [(i, "word " * (i % 3)) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    pieces = packing.token_pieces(frame, tokenizer_file(FILE), 16).cache()
    check_rows(packing.best_fit_pack(pieces, 16, part_rows=7).collect(), docs, 16)
    plan = packing.best_fit_pack(pieces, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2
    pieces.unpersist()
