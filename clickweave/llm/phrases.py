"""Substring dedup: words of recurring phrases are removed from all documents but the first that holds them.

A window of ``length`` words is removed where its words also start in a document with a smaller doc_id. Passages that can recur
are found through anchors (see ``windows``). For those that equal spans do not settle, the passages are dealt into shards by the
hash of their anchor, so equal windows meet. Each shard confirms which windows recur, and the smallest document that holds
each; compiles them into an Aho-Corasick automaton over word numbers; and streams its passages through the automaton, which
tells every place where a confirmed window occurs.

Null and empty texts have no words; texts with fewer words than ``length`` lose none. Of rows that share a doc_id none is
smaller, so they do not cover each other. Rows without doc_id have no order: they lose nothing and cover nothing. An empty
table gives an empty result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.llm import windows
from clickweave.llm.windows import Kind

LENGTH = 13
GRAM = 4
#: Words of a long text that are held as objects at a time.
GROUP = 1 << 17
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _passages(kind: Kind, shards: int):
    """(shard, doc, span, words of the passage) of the open spans that are not hot."""

    def run(batches):
        for batch in batches:
            rows = []
            for o in windows.open_spans(batch, kind):
                a, data, found = o.piece.anchors, o.piece.chunk.data, o.piece.words
                for doc, anchor, hot in zip(o.doc.tolist(), o.anchor.tolist(), o.hot.tolist(), strict=True):
                    if not hot:
                        first, last = a.low[anchor], a.high[anchor] + kind.length - 1
                        rows.append((int(a.gram_hash[anchor]) % shards, doc, int(a.span_hash[anchor]),
                                     data[found.starts[first]:found.ends[last]].tobytes()))
            if rows:
                types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 names=["shard", "doc", "span", "passage"])

    return run


def confirmed_windows(passages: list[tuple[int, tuple[int, ...]]], length: int) -> dict[tuple[int, ...], int]:
    """The windows that more than one document holds, with the smallest such document. ``passages``: (document, word numbers)."""
    first: dict[tuple[int, ...], int] = {}
    several: set[tuple[int, ...]] = set()
    for doc, words in passages:
        for at in range(len(words) - length + 1):
            window = words[at:at + length]
            known = first.setdefault(window, doc)
            if known != doc:
                several.add(window)
                first[window] = min(known, doc)
    return {window: first[window] for window in several}


def compile_automaton(confirmed: dict[tuple[int, ...], int]) -> ahocorasick.Automaton | None:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for window, doc in confirmed.items():
        automaton.add_word(window, doc)
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def covered_windows(automaton: ahocorasick.Automaton, doc: int, words: tuple[int, ...], length: int) -> list[tuple[int, int]]:
    """Stretches (low, high) of windows of a passage that a smaller document holds as well."""
    found: list[tuple[int, int]] = []
    for end, smallest in automaton.iter(words):
        if smallest < doc:
            at = end - length + 1
            if found and found[-1][1] == at - 1:
                found[-1] = (found[-1][0], at)
            else:
                found.append((at, at))
    return found


def _stream_shard(kind: Kind):
    def run(key, table):
        numbers: dict[bytes, int] = {}
        docs, spans = table.column("doc").to_pylist(), table.column("span").to_pylist()
        passages = [tuple(numbers.setdefault(w, len(numbers)) for w in p.split()) for p in table.column("passage").to_pylist()]
        # Automata work on numbers of documents in order, as the ids themselves may be large or negative.
        order = {doc: i for i, doc in enumerate(sorted(set(docs)))}
        numbered = [(order[doc], words) for doc, words in zip(docs, passages, strict=True)]
        automaton = compile_automaton(confirmed_windows(numbered, kind.length))
        rows = []
        if automaton is not None:
            for doc, span, (number, words) in zip(docs, spans, numbered, strict=True):
                rows += [(doc, span, low, high) for low, high in covered_windows(automaton, number, words, kind.length)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["doc", "span", "low", "high"])

    return run


def recurring_windows(texts: DataFrame, kind: Kind) -> DataFrame:
    def compare(opened: DataFrame, shards: int) -> DataFrame:
        passages = opened.mapInArrow(_passages(kind, shards), "shard int, doc long, span long, passage binary")
        return passages.groupBy("shard").applyInArrow(_stream_shard(kind), "doc long, span long, low long, high long")

    return windows.repeated_windows(texts, kind, "phrases", compare)


def _word_groups(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text; those of a long one in groups, as objects take many times the bytes of their words."""
    if len(text) <= windows.PIECE:
        yield text.split()
        return
    found = (match.group() for match in _WORD.finditer(text))
    while group := list(islice(found, GROUP)):
        yield group


def without_words(text: bytes, mask: np.ndarray | None) -> tuple[int, bytes]:
    """(number of words, those not in the mask joined by one space)."""
    n, parts = 0, []
    for group in _word_groups(text):
        stay = group if mask is None else list(compress(group, ~mask[n:n + len(group)]))
        n += len(group)
        if stay:
            parts.append(b" ".join(stay))
    return n, b" ".join(parts)


def remove_recurring(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept (the remaining words joined by one space)."""
    kind = Kind(length, gram, words=True, ordered=True)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    recurring = recurring_windows(texts.where(F.col("doc").isNotNull()), kind)

    def cut(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            texts = batch.column(1).to_pylist()
            for row, mask in windows.removed_units(batch, kind, 1, 2):
                n, rest = without_words(texts[row], mask)
                n_words.append(n)
                n_removed.append(0 if mask is None else int(mask.sum()))
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    return windows.with_removals(texts, recurring).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")
