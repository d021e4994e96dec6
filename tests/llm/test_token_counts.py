from __future__ import annotations

import random

import pytest

from clickweave.llm.queries import op2_token_counts, tokenizer_file
from clickweave.llm.token_counts import PieceCounter, balanced, token_counts

SPECIAL = ["", " ", "  ", "a", "a ", " a", "  a  b ", "a\nb", "a \n b", "▁", "a▁ b", " ▁ ▁", "<s> </s> <unk>", "é ü  ñ", "\x00 x",
           "x" * 500, "de <s>de", "\t\ta  \t b", "😀 😀😀", "a b", "´ e", "0123 4567   89"]


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(tokenizer_file("piece_bpe_32k.model"))


def test_parts_add_up(counter):
    rng = random.Random(1)
    texts = SPECIAL + ["".join(rng.choice("ab ▁é\n.<s>1 ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert counter.splits
    assert counter.counts(texts) == [len(counter.model.encode(text)) for text in texts]


def test_small_memory(counter):
    small = PieceCounter(tokenizer_file("piece_bpe_32k.model"), memory=3)
    assert small.counts(SPECIAL) == small.counts(SPECIAL) == [len(counter.model.encode(text)) for text in SPECIAL]


def test_batches_hold_every_text():
    sizes = [5, 0, 40, 3, 3, 100, 1]
    cut = list(balanced(sizes, 10))
    assert [i for start, end in cut for i in range(start, end)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) <= 10 or b - a == 1 for a, b in cut)
    assert list(balanced([])) == []


def test_whole_table(spark, small_dir, counter):
    got = {row.doc_id: row for row in op2_token_counts(spark, small_dir).collect()}
    for row in spark.read.parquet(f"{small_dir}/documents.parquet").collect():
        n = len(counter.model.encode(row.text))
        assert (got[row.doc_id].n_bytes, got[row.doc_id].n_tokens, got[row.doc_id].over_limit) == (len(row.text.encode()), n, n > 4096)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (None, "a b", "y"), (2, "", None), (3, "a b", "z"), (3, "a b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    model = tokenizer_file("piece_bpe_32k.model")
    got = sorted(token_counts(docs, model, limit=1).collect(), key=str)
    assert sorted((row.n_tokens, row.over_limit) for row in got) == [(0, False), (0, False), (2, True), (2, True), (2, True)]
    assert token_counts(docs.limit(0), model).collect() == []
