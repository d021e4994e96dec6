from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from clickweave.llm import phrases, suffixes, windows
from clickweave.llm.windows import Kind

LIMIT = 1 << 24


def found_windows(texts, kind, most):
    """(row, place of the window, place of its anchor within it, its hash) of all windows, sorted."""
    out = []
    for p in windows.pieces(pa.array(texts, pa.binary()), kind, most):
        a = p.anchors
        for text, at, low, high in zip(a.text, a.at, a.low, a.high):
            for start in range(low, high + 1):
                where = np.array([start])
                out.append((int(p.chunk.first + text), int(p.skipped + start - p.bounds[text]), int(at - start),
                            int(p.units.of(where, where + kind.length)[0])))
    return sorted(out)


@pytest.mark.parametrize("kind", [Kind(12, 4, False, False), Kind(5, 2, True, True), Kind(1, 1, True, True)])
def test_stretches_hold_every_window_once(kind):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc  \n") for _ in range(n)).encode() for n in (0, 5, 64, 65, 700, 1000)]
    texts += [b"x" * 300, b" " * 300, b"y" * 200 + b" a b" * 40 + b" " * 90 + b"z" * 150, b" ".join([b"one"] * 200)]
    texts += [b"w" * 2000 + b" a" * 3000, b"a b " * 100 + b"w" * 2000 + b" c" * 50 + b" " + b"v" * 900]
    assert all(len(p.units.sums) < 160 for p in windows.pieces(pa.array(texts, pa.binary()), kind, 64) if kind.words)
    assert found_windows(texts, kind, 64) == found_windows(texts, kind, 1 << 20)


def written(spark, folder, texts):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def places(n, size):
    """Starts of stretches of ``size`` units: at both ends, across 2^24 units and across the pieces' edges."""
    return [0, windows.PIECE - size // 2, 2 * windows.PIECE - 7, LIMIT - windows.PIECE // 3, LIMIT - size // 2, n - size]


def test_bytes_of_a_text_across_2_24(spark, tmp_path):
    n = LIMIT + 5000
    text = np.random.default_rng(1).choice(np.frombuffer(b"abcdefghijklmnop", np.uint8), n).tobytes().decode()
    gone = np.zeros(n, bool)
    for at in places(n, 300):
        gone[at:at + 300] = True
    frame = written(spark, tmp_path, [text, "X".join(text[at:at + 300] for at in places(n, 300)), "Y" * 150])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeated(frame).collect()}
    assert got == {0: (n, 1800, 6, np.frombuffer(text.encode(), np.uint8)[~gone].tobytes()), 1: (1805, 1800, 6, b"XXXXX"), 2: (150, 0, 0, b"Y" * 150)}


def test_words_of_a_text_across_2_24(spark, tmp_path):
    n = LIMIT + 5000
    words = np.full((n, 2), 0x20, np.uint8)
    words[:, 0] = np.random.default_rng(2).choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8), n)
    passages = [words[at:at + 40].tobytes().decode() for at in places(n, 40)]
    gone = np.zeros(n, bool)
    for at in places(n, 40):
        gone[at:at + 40] = True
    frame = written(spark, tmp_path, ["X ".join(passages), words.tobytes().decode(), "Y " * 9])
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in phrases.remove_recurring(frame).collect()}
    assert got[0][:2] == (245, 0) and got[2] == (9, 0, b" ".join([b"Y"] * 9))
    assert got[1] == (n, 240, words[~gone].tobytes()[:-1])
