from __future__ import annotations

import hashlib
import random
import re

import pytest

from clickweave.llm import phrases
from clickweave.llm.queries import op9_phrase_dedup


def plain(docs, length):
    """(n_words, n_removed, remaining words) of each (doc_id, text), from all its windows."""
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in docs]
    first = {}
    for (doc_id, _), words in zip(docs, split):
        if doc_id is not None:
            for i in range(len(words) - length + 1):
                window = tuple(words[i:i + length])
                first[window] = min(first.get(window, doc_id), doc_id)
    out = []
    for (doc_id, _), words in zip(docs, split):
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if doc_id is not None and first[tuple(words[i:i + length])] < doc_id:
                gone[i:i + length] = [True] * length
        out.append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g).encode()))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = lambda k: [rng.choice("abcdefgé") * rng.randrange(1, 3) for _ in range(k)]
    passages = [words(rng.randrange(3, 30)) for _ in range(9)]
    texts = [None, "", " \t", "same " * 50, "same " * 9, "a b " * 30]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts += rng.choice(passages)[rng.randrange(3):] if rng.random() < 0.5 else words(rng.randrange(20))
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    return texts + texts[8:12]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, seed):
    rng = random.Random(seed)
    texts = corpus(seed)
    ids = rng.sample(range(-1000, 1000), len(texts))
    ids[20], ids[40], ids[41] = None, ids[30], ids[30]
    docs = list(zip(ids, texts))
    rows = phrases.remove_recurring(spark.createDataFrame(docs, "doc_id long, text string"), length=6, gram=2).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in rows), key=key) == sorted(
        ((doc_id, *p) for (doc_id, _), p in zip(docs, plain(docs, 6))), key=key)


def test_widespread_passage(spark):
    """A passage in more documents than one shard may hold open spans of, in ever other surroundings."""
    rng = random.Random(1)
    words = lambda k: [str(rng.randrange(50)) for _ in range(k)]
    passage = words(9)
    docs = [(i, " ".join(words(rng.randrange(5, 9)) + passage + words(rng.randrange(5, 9)))) for i in range(1500)]
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept))
           for r in phrases.remove_recurring(spark.createDataFrame(docs, "doc_id long, text string"), length=6, gram=2).collect()}
    assert [got[i] for i, _ in docs] == plain(docs, 6)


def test_automaton_finds_every_confirmed_window():
    passages = [(3, (1, 2, 3, 4, 5)), (1, (9, 2, 3, 4, 5, 2, 3, 4)), (2, (7, 7, 7, 7))]
    confirmed = phrases.confirmed_windows(passages, 3)
    assert confirmed == {(2, 3, 4): 1, (3, 4, 5): 1}
    automaton = phrases.compile_automaton(confirmed)
    assert [phrases.covered_windows(automaton, doc, words, 3) for doc, words in passages] == [[(1, 2)], [], []]
    assert phrases.compile_automaton({}) is None


def test_whole_table(spark, small_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op9_phrase_dedup(spark, small_dir).collect()}
    want = {doc_id: (n, gone, hashlib.sha256(kept).hexdigest()) for (doc_id, _), (n, gone, kept) in zip(docs, plain(docs, 13))}
    assert got == want and sum(gone for _, gone, _ in want.values()) > 0


def test_odd_rows(spark):
    long = " ".join(map(str, range(40)))
    frame = spark.createDataFrame([(2, long, 1), (2, long, 1), (1, long, 1), (None, long, 1), (5, None, 1), (6, "", 1)], "doc_id long, text string, span int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in phrases.remove_recurring(frame).collect()), key=str)
    assert got == sorted([(1, 40, 0), (2, 40, 40), (2, 40, 40), (5, 0, 0), (6, 0, 0), (None, 40, 0)], key=str)
    assert phrases.remove_recurring(frame.limit(0)).collect() == []
