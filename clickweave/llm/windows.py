"""Finding repeated windows (of bytes or of words) in a corpus, and cutting them out: the steps that two operators share.

1. Every text's anchors (see ``anchors``) are sent as (hash of the anchor's gram, hash of its span, document). Inside a piece of
   about a megabyte equal spans are sent no more than twice, so copies and monotonous texts weigh little. A longer text is looked
   at in stretches that overlap by a window less one unit, so texts have no greatest length.
2. Rows sorted by gram and span are read in one pass that remembers one row: equal spans settle all windows of their anchors at once;
   spans that share a gram with another span, but are not settled, stay open. Most anchors have a gram of their own and end here.
3. The operator compares the windows of open spans with its own method, gram by gram. Grams with more than ``HOT`` open
   spans (widespread passages in ever other surroundings) are dealt out by the hash of each window instead, so that no task
   holds such a group.
4. What is settled is collected per document, as spans and ranges of windows in them, and applied to its text.

Results say which windows of a span are repeated; they hold for every row of a document that has this span, so rows that share a
doc_id need no telling apart. Hashes have 64 bits and are taken as free of collisions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.llm import bytescan
from clickweave.llm.anchors import Anchors, find_anchors
from clickweave.llm.shared import materialized

#: More open spans than this on one gram are dealt out by window.
HOT = 1024
#: Open spans in one shard of step 3.
SHARD = 20_000
#: Bytes of text looked at together.
PIECE = 1 << 20
_COVERED, _OPEN = 0, 1


class Kind(NamedTuple):
    """``length`` units make a window, ``gram`` an anchor; units are words or bytes. ``ordered``: a window counts as repeated only
    where a smaller document holds it."""

    length: int
    gram: int
    words: bool
    ordered: bool


class Piece(NamedTuple):
    """A chunk, its words (None for bytes), the hashes over its units, each text's first unit, and the anchors. ``skipped``: units
    of the text before this piece, where it is a stretch of a long text; ``ends``: whether its last text ends here."""

    chunk: bytescan.Chunk
    words: bytescan.Words | None
    units: bytescan.Hashes
    bounds: np.ndarray
    anchors: Anchors
    skipped: int
    ends: bool


def _stretches(chunk: bytescan.Chunk, kind: Kind, most: int) -> Iterator[tuple[bytescan.Chunk, bytescan.Words | None, int, bool]]:
    """(stretch, its words, units before it, whether the text ends) of a chunk: itself, or of a text of more than ``most`` bytes
    stretches that overlap by ``length - 1`` units, so that every window is in one of them. No word is cut."""
    data, start, size, skipped = chunk.data, 0, most, 0
    while len(chunk.bounds) == 2 and start + most < len(data):
        part, words = data[start:start + size], None
        ends = start + size >= len(data)
        if kind.words:
            if not ends:
                gaps = np.flatnonzero(~bytescan.inside_word(part))
                part = part[:gaps[-1] if len(gaps) else 0]
            words = bytescan.words(bytescan.Chunk(chunk.first, part, np.array([0, len(part)])))
            if size > most and len(words.starts) > kind.length:  # behind very long words there may be many short ones
                n = int(np.searchsorted(words.ends, words.ends[kind.length - 1] + most, "right"))
                ends &= n == len(words.starts)
                if not ends:
                    part = part[:words.ends[n - 1]]
                    words = bytescan.Words(words.starts[:n], words.ends[:n], np.array([0, n]))
        fresh = (len(part) if words is None else len(words.starts)) - kind.length + 1
        if not ends and fresh < 1:  # no whole window yet: very long words, or stretches of space
            size *= 2
            continue
        yield bytescan.Chunk(chunk.first, part, np.array([0, len(part)])), words, skipped, ends
        if ends:
            return
        if words is None:
            start += fresh
        else:
            start += int(words.starts[fresh]) if kind.length > 1 else len(part)
        skipped, size = skipped + fresh, most
    rest = bytescan.Chunk(chunk.first, data[start:], np.array([0, len(data) - start])) if start else chunk
    yield rest, bytescan.words(rest) if kind.words else None, skipped, True


def pieces(texts: pa.Array, kind: Kind, most: int = PIECE) -> Iterator[Piece]:
    for whole in bytescan.chunks(texts, most):
        for chunk, words, skipped, ends in _stretches(whole, kind, most):
            units = bytescan.Hashes(bytescan.word_hashes(chunk, words) if kind.words else chunk.data)
            bounds = words.bounds if kind.words else chunk.bounds
            yield Piece(chunk, words, units, bounds, find_anchors(units, bounds, kind.length, kind.gram), skipped, ends)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _entries(kind: Kind) -> Callable:
    """(gram, span, doc, settled): one row or two per span and piece; documents settled within the piece come as such."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for piece in pieces(batch.column(1), kind):
                a = piece.anchors
                doc = ids[piece.chunk.first + a.text]
                order = np.lexsort((doc, a.span_hash))
                span, doc, gram = a.span_hash[order], doc[order], a.gram_hash[order]
                if not len(span):
                    continue
                new = np.ones(len(span), bool)
                new[1:] = span[1:] != span[:-1]
                run_of = np.cumsum(new) - 1
                first = np.flatnonzero(new)
                size = np.diff(first, append=len(span))[run_of]
                if kind.ordered:
                    send = new
                    settled = doc != doc[first][run_of]
                else:
                    send = np.arange(len(span)) - first[run_of] < 2
                    settled = ~send & (size > 2)
                fresh = np.ones(len(span), bool)
                fresh[1:] = (span[1:] != span[:-1]) | (doc[1:] != doc[:-1])
                settled &= fresh
                where = np.concatenate([gram[send], bytescan.mixed(doc[settled].astype(np.uint64)).astype(np.int64)])
                yield _batch(gram=where, span=np.concatenate([span[send], span[settled]]), doc=np.concatenate([doc[send], doc[settled]]),
                             settled=np.concatenate([np.zeros(send.sum(), bool), np.ones(settled.sum(), bool)]))

    return run


def _runs(kind: Kind) -> Callable:
    """From rows sorted by gram, span and document: what is settled, and the spans that stay open (``alone``: met once)."""

    def out(gram, span, doc, alone, what):
        return _batch(gram=gram, span=span, doc=doc, alone=alone, kind=np.full(len(gram), what, np.int32))

    def run(batches):
        held = np.zeros((3, 0), np.int64)  # the first row of the span that the last batch ended in
        held_twice, held_beside = False, False  # whether that span was met twice; whether its gram has other spans
        for batch in batches:
            settled = batch.column(3).to_numpy(zero_copy_only=False)
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)])
            if settled.any():
                done = rows[:, settled]
                yield out(*done, np.zeros(done.shape[1], bool), _COVERED)
            rows = np.concatenate([held, rows[:, ~settled]], 1)
            if rows.shape[1] == held.shape[1]:
                continue
            gram, span, doc = rows
            new_gram = np.ones(len(gram), bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new_span = new_gram.copy()
            new_span[1:] |= span[1:] != span[:-1]
            first = np.flatnonzero(new_span)
            run_of = np.cumsum(new_span) - 1
            twice = np.diff(first, append=len(span)) >= 2
            twice[0] |= held_twice and held.shape[1] == 1
            gram_of = np.cumsum(new_gram)[first] - 1
            beside = np.bincount(gram_of) >= 2
            beside[0] |= held_beside and held.shape[1] == 1
            covered = doc != doc[first][run_of] if kind.ordered else twice[run_of]
            if covered.any():
                done = rows[:, covered]
                yield out(*done, np.zeros(done.shape[1], bool), _COVERED)
            open_ = beside[gram_of]
            open_[-1] = False
            if open_.any():
                yield out(*rows[:, first[open_]], ~twice[open_], _OPEN)
            held, held_twice, held_beside = rows[:, first[-1]:first[-1] + 1], bool(twice[-1]), bool(beside[-1])
        if held.shape[1] and held_beside:
            yield out(*held, np.array([not held_twice]), _OPEN)

    return run


class OpenSpans(NamedTuple):
    """Open spans of one piece: which text and which anchor each is, and what is known of it."""

    piece: Piece
    doc: np.ndarray
    anchor: np.ndarray
    alone: np.ndarray
    hot: np.ndarray


def open_spans(batch: pa.RecordBatch, kind: Kind) -> Iterator[OpenSpans]:
    """``batch`` holds doc, text and the list of its open spans (span, alone, hot)."""
    ids, lists = batch.column(0).to_numpy(), batch.column(2)
    offsets = lists.offsets.to_numpy()
    flat = lists.values
    span, alone, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    sorted_row = -1
    for piece in pieces(batch.column(1), kind):
        a = piece.anchors
        edges = np.searchsorted(a.text, np.arange(len(piece.bounds)))
        chosen, which = [], []
        for i in range(len(piece.bounds) - 1):
            row = piece.chunk.first + i
            if row != sorted_row:  # once for all stretches of a long text
                order = np.argsort(span[offsets[row]:offsets[row + 1]])
                wanted, sorted_row = span[offsets[row]:offsets[row + 1]][order], row
            own, at = np.unique(a.span_hash[edges[i]:edges[i + 1]], return_index=True)
            if not len(own) or not len(wanted):
                continue
            place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            found = np.flatnonzero(wanted[place] == own)
            chosen.append(edges[i] + at[found])
            which.append(offsets[row] + order[place[found]])
        if chosen:
            anchor, which = np.concatenate(chosen), np.concatenate(which)
            yield OpenSpans(piece, ids[piece.chunk.first + a.text[anchor]], anchor, alone[which], hot[which])


def _dealt_windows(kind: Kind) -> Callable:
    """Every window of the hot open spans: (window, doc, span, at, alone)."""

    def run(batches):
        for batch in batches:
            for o in open_spans(batch, kind):
                a, pick = o.piece.anchors, o.anchor[o.hot]
                n = a.high[pick] - a.low[pick] + 1
                if not len(n):
                    continue
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(a.low[pick], n) + at
                yield _batch(window=o.piece.units.of(start, start + kind.length).astype(np.int64), doc=np.repeat(o.doc[o.hot], n),
                             span=np.repeat(a.span_hash[pick], n), at=at, alone=np.repeat(o.alone[o.hot], n))

    return run


def _repeated_windows(kind: Kind) -> Callable:
    """From rows sorted by window and document: (doc, span, low, high) of the windows that are repeated, one row each."""

    def out(rows):
        return _batch(doc=rows[1], span=rows[2], low=rows[3], high=rows[3])

    def run(batches):
        held, held_twice = np.zeros((5, 0), np.int64), False
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            rows = np.concatenate([held, rows], 1)
            if not rows.shape[1]:
                continue
            new = np.ones(rows.shape[1], bool)
            new[1:] = rows[0, 1:] != rows[0, :-1]
            first = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            twice = np.diff(first, append=rows.shape[1]) >= 2
            twice |= np.add.reduceat(1 - rows[4], first) > 0  # a span met twice elsewhere
            twice[0] |= held_twice and held.shape[1] == 1
            done = rows[1] != rows[1][first][run_of] if kind.ordered else twice[run_of]
            if done.any():
                yield out(rows[:, done])
            held, held_twice = rows[:, first[-1]:first[-1] + 1], bool(twice[-1])

    return run


def repeated_windows(texts: DataFrame, kind: Kind, name: str, compare: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Rows doc, span, low, high: windows ``low`` to ``high`` of that span are repeated (high -1: all of them).

    ``texts`` holds doc (long) and text (binary). ``compare`` gets the open spans' texts (doc, text, spans) without the hot grams and
    a number of shards, and returns such rows.
    """
    entries = texts.mapInArrow(_entries(kind), "gram long, span long, doc long, settled boolean")
    found = materialized(
        entries.repartition("gram").sortWithinPartitions("gram", "span", "doc").mapInArrow(
            _runs(kind), "gram long, span long, doc long, alone boolean, kind int"), f"{name}-spans", "kind")
    settled = found.where(F.col("kind") == _COVERED).select("doc", "span", F.lit(0).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"))
    still_open = found.where(F.col("kind") == _OPEN)
    n_open = still_open.count()
    hot = still_open.groupBy("gram").count().where(F.col("count") > HOT).select("gram", F.lit(True).alias("hot"))
    marked = still_open.join(hot, "gram", "left").select("doc", F.struct("span", "alone", F.coalesce("hot", F.lit(False)).alias("hot")).alias("s"))
    lists = marked.groupBy("doc").agg(F.collect_list("s").alias("spans"))  # no more than a text has anchors
    opened = materialized(texts.join(lists.hint("shuffle_hash"), "doc").select("doc", "text", "spans"), f"{name}-open")
    compared = compare(opened, max(1, -(-n_open // SHARD)))
    dealt = opened.where(F.exists("spans", lambda s: s["hot"])).mapInArrow(
        _dealt_windows(kind), "window long, doc long, span long, at long, alone boolean")
    from_hot = dealt.repartition("window").sortWithinPartitions("window", "doc").mapInArrow(
        _repeated_windows(kind), "doc long, span long, low long, high long")
    return settled.union(materialized(compared.union(from_hot), f"{name}-windows"))


def with_removals(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """``texts`` with the list of its repeated windows (span, low, high), empty where there are none."""
    lists = repeated.groupBy("doc").agg(F.collect_list(F.struct("span", "low", "high")).alias("repeated"))
    # Empty, not null: a batch for Python takes a time that grows with the run of nulls in a list column.
    none = F.array().cast("array<struct<span:bigint,low:bigint,high:bigint>>")
    return texts.join(lists.hint("shuffle_hash"), "doc", "left").select(*texts.columns, F.coalesce("repeated", none).alias("repeated"))


def _joined(stretches: list[tuple[int, int, np.ndarray | None]]) -> np.ndarray | None:
    """The mask of a long text from (units before, units, mask) of its stretches."""
    if all(mask is None for _, _, mask in stretches):
        return None
    whole = np.zeros(stretches[-1][0] + stretches[-1][1], bool)
    for skipped, size, mask in stretches:
        if mask is not None:
            whole[skipped:skipped + size] |= mask
    return whole


def removed_units(batch: pa.RecordBatch, kind: Kind, text: int, repeated: int) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, mask of its units that repeated windows cover) for every row of a batch; None for none."""
    lists = batch.column(repeated)
    offsets, flat = lists.offsets.to_numpy(), lists.values
    span, low, high = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    sorted_row, stretches = -1, []
    for piece in pieces(batch.column(text), kind):
        a = piece.anchors
        edges = np.searchsorted(a.text, np.arange(len(piece.bounds)))
        for i in range(len(piece.bounds) - 1):
            row = piece.chunk.first + i
            mine = slice(offsets[row], offsets[row + 1])
            own = slice(edges[i], edges[i + 1])
            size = int(piece.bounds[i + 1] - piece.bounds[i])
            mask = None
            if mine.start != mine.stop and own.start != own.stop:
                if row != sorted_row:  # once for all stretches of a long text
                    order = np.argsort(span[mine], kind="stable")
                    spans, lows, highs, sorted_row = span[mine][order], low[mine][order], high[mine][order], row
                left, right = (np.searchsorted(spans, a.span_hash[own], side) for side in ("left", "right"))
                n = right - left
                which = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first, last = np.repeat(a.low[own], n), np.repeat(a.high[own], n)
                start = first + lows[which] - piece.bounds[i]
                end = np.where(highs[which] < 0, last, first + highs[which]) + kind.length - piece.bounds[i]
                change = np.zeros(size + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, end, -1)
                mask = np.cumsum(change[:-1]) > 0
            if not piece.skipped and piece.ends:
                yield row, mask
                continue
            stretches.append((piece.skipped, size, mask))
            if piece.ends:
                yield row, _joined(stretches)
                stretches = []
