from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from clickweave.llm import jaccard, packing, quality, secrets, shared

MB = 1 << 20


def held() -> int:
    """Anonymous memory of this process in MB."""
    return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024


def test_freed_memory_goes_back():
    shared.give_memory_back()
    before = held()
    column = pa.array(np.ones(16 * MB))
    freed = [bytes(1000 + i % 7) for i in range(100_000)]
    assert held() > before + 150
    del column, freed
    shared.give_memory_back()
    assert held() < before + 30


def test_task_gives_memory_back_at_its_end(spark):
    """The worker's allocators hold what the function has freed; measured there by the next task, before it does anything."""
    def hungry(batches):
        for batch in batches:
            kept = [pa.array(np.full(1000 + i, 1.0)) for i in range(20_000)]
            sizes = sum(map(len, kept))
            del kept
            yield pa.RecordBatch.from_arrays([pa.array([sizes])], names=["id"])

    def measured(batches):
        now = held()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([now] * batch.num_rows)], names=["id"])

    from clickweave.llm.shared import in_arrow
    one = spark.range(1).coalesce(1)
    start = max(r.id for r in spark.range(0, 64, 1, 8).mapInArrow(measured, "id long").collect())
    for _ in range(3):
        assert in_arrow(one, hungry, "id long").collect()[0].id > 0
    assert max(r.id for r in spark.range(0, 64, 1, 8).mapInArrow(measured, "id long").collect()) < start + 80


def test_words_between_tasks(spark):
    import public_tokenizers

    file = public_tokenizers.path(corpus_pipeline.TOKENIZER)
    encoder = packing.WordEncoder(file, 100)
    first = encoder.encode([b"one two three four"])
    encoder.rest(4)
    assert len(encoder.known) == 4
    encoder.rest(3)
    assert not encoder.known and encoder.encode([b"one two three four"]) == first

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    memory = 1001  # an encoder of this test alone
    kept = packing.token_pieces(docs, file, memory=memory, between=10).collect()

    def known(batches):
        for batch in batches:
            found = packing._ENCODERS.get((file, memory))
            yield pa.RecordBatch.from_arrays([pa.array([len(found.known) if found else 0] * batch.num_rows, pa.int64())], names=["id"])

    assert max(r.id for r in spark.range(0, 64, 1, 8).mapInArrow(known, "id long").collect()) <= 10
    assert sorted(kept) == sorted(packing.token_pieces(docs, file, memory=memory).collect())


@pytest.mark.parametrize("module", [jaccard, packing, quality, secrets])
def test_stages_of_the_pipeline_give_memory_back(spark, small_dir, monkeypatch, module):
    """No stage hands rows to Python past the helper."""
    plain, through = type(spark.range(1)).mapInArrow, []
    past = []

    def watched(df, function, *more, **named):
        (through if function.__qualname__.startswith("in_arrow") else past).append(function.__module__)
        return plain(df, function, *more, **named)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", watched)
    docs = shared.table(spark, small_dir, "documents").limit(50)
    stage = {jaccard: corpus_pipeline.drop_near_copies, packing: corpus_pipeline.pack_sequences,
             quality: corpus_pipeline.reject_low_quality, secrets: corpus_pipeline.redact_secrets}[module]
    stage(spark, docs, small_dir).collect()
    assert through and not past
