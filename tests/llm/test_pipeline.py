from __future__ import annotations

import math
from collections import Counter

import corpus_pipeline
from clickweave.llm import mixing, quality, secrets
from clickweave.llm.shared import table
from tests.llm.test_jaccard import plain_components
from tests.llm.test_mixing import plain_targets
from tests.llm.test_packing import check_rows
from tests.llm.test_secrets import plain_spans


def test_stages_against_plain_ones(spark, oracle_dir):
    docs = table(spark, oracle_dir, "documents")
    kept = [docs.collect()]
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.materialized(stage(spark, frame, oracle_dir), "stage")
        kept.append(frame.collect())
        assert name and (frame.columns == docs.columns or stage is corpus_pipeline.STAGES[-1][1])
    raw, good, single, clean, mixed, packed = kept

    label = {r.doc_id: r.quality for r in table(spark, oracle_dir, "labels").collect()}
    stayed = {r.doc_id for r in good}
    assert set(good) <= set(raw) and 0.6 * len(raw) < len(good) < len(raw)
    assert sum((r.doc_id in stayed) == bool(label[r.doc_id]) for r in raw if r.doc_id in label) > 0.97 * sum(r.doc_id in label for r in raw)

    component = plain_components([(r.doc_id, r.text) for r in good])
    assert Counter(single) == Counter(r for r in good if component[r.doc_id][1] == r.doc_id)

    before = {r.doc_id: r for r in single}
    assert len(clean) == len(single)
    for r in clean:
        old = before[r.doc_id]
        assert plain_spans(r.text) == [] and (r.lang, r.source) == (old.lang, old.source)
        if not plain_spans(old.text):
            assert r == old or secrets.MARK in r.text
        elif r.text != old.text:
            assert r.n_chars == len(r.text)

    size = Counter()
    for r in clean:
        size[r.source] += len(r.text.split())
    copies = Counter(r.doc_id for r in mixed)
    targets, taken = plain_targets(size), Counter()
    for r in clean:
        assert copies[r.doc_id] <= 2
        taken[r.source] += copies[r.doc_id] * len(r.text.split())
    assert all(abs(taken[s] - t) < 6000 for s, t in targets.items()) and set(mixed) <= set(clean)

    texts = {r.doc_id: r.text for r in mixed}
    once = {(r.doc_id, r.piece): r for r in packed}
    check_rows_once = [r for r in once.values()]
    assert Counter((r.doc_id, r.piece) for r in packed) == Counter({key: copies[key[0]] for key in once})
    assert {r.doc_id for r in check_rows_once} == set(texts)
    n = len({r.sequence_id for r in packed})
    assert n <= 1.02 * math.ceil(sum(r.length for r in packed) / 2048) + 1


def test_run_and_odd_rows(spark, small_dir):
    run = corpus_pipeline.run(spark, small_dir)
    assert run.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and run.count() > 0
    rows = [(1, None, None, None, None, "e"), (2, "", "en", "a", 0, "e"), (None, "b c", "en", "a", 3, "e"), (3, "token = abcdef1", "en", "", 15, None),
            (3, "token = abcdef1", "en", "", 15, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    model = quality.fit([], [])
    assert Counter(quality.keep_good(docs, model).collect()) == Counter(docs.collect())
    assert len(corpus_pipeline.drop_near_copies(spark, docs, small_dir).collect()) == 4
    clean = corpus_pipeline.redact_secrets(spark, docs, small_dir).collect()
    assert Counter(r.text for r in clean) == Counter([None, "", "b c", "<secret>", "<secret>"])
    assert {r.n_chars for r in clean if r.text == "<secret>"} == {8}
    mixed = mixing.mix_documents(docs).collect()
    assert all(r in docs.collect() for r in mixed)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small_dir).collect() == []


def test_columns_of_any_name_stay_as_they_are(spark, small_dir):
    names = ("_text", "_kept", "_at", "a.b", "row", "id", "kept", "turn", "text_hash", "document", "copies", "size", "class")
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "s", 3), (2, text + " more", "en", "s", 4), (5, "quite another text", "fr", "s", 5), (None, text, "en", "s", 6)]
    whole = [(*row, *(f"{name} of {row[0]}" for name in names)) for row in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{name}` string" for name in names)
    docs = spark.createDataFrame(whole, schema)
    single = corpus_pipeline.drop_near_copies(spark, docs, small_dir)
    assert single.columns == docs.columns
    assert sorted((tuple(r) for r in single.collect()), key=str) == sorted((r for r in whole if r[0] != 2), key=str)
    for stage in (lambda d: quality.keep_good(d, quality.fit([], [])), secrets.redact, mixing.mix_documents):
        kept = stage(docs)
        assert kept.columns == docs.columns
        assert {tuple(r)[5:] for r in kept.collect()} <= {row[5:] for row in whole}
    assert corpus_pipeline.pack_sequences(spark, docs, small_dir).count() == 4


def test_spans_are_replaced_once():
    assert secrets.redacted_text("abcdefgh", [(1, 3), (2, 4), (6, 7)], "#") == "a#ef#h"
    assert secrets.redacted_text("abc", []) == "abc" and secrets.redacted_text("abc", [(0, 3)], "#") == "#"


def test_packed_rows_of_plain_documents(spark):
    docs = [(1, "a b c"), (2, "d " * 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    import public_tokenizers

    from clickweave.llm import packing
    check_rows(packing.pack_documents(frame, public_tokenizers.path(corpus_pipeline.TOKENIZER), 16).collect(), docs, 16)
