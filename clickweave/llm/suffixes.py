"""Suffix-array dedup: exact removal of bytes in strings of ``length`` bytes that start in more than one place.

Suffixes at anchors are sorted, not all suffixes: a string that occurs twice has the same anchor in both places (see
``windows``), and anchors whose gram or whole span settles the question by hash need no sorting. The open ones are sorted by
the bytes behind the anchor. Each task sorts its own and writes front-coded runs: for every suffix the length of the prefix it shares with
the one before, and the rest. Runs are exchanged by a hash of the anchor's gram and merged with a loser tree whose nodes remember
how far each loser agrees with the last winner: suffixes whose remembered prefixes differ are ordered without looking at bytes,
others are compared from the end of what they are known to share. The merge thus yields the sorted suffixes with the
common prefix of neighbours, which bounds what each suffix can share with any other. Within that bound its strings, which reach
back before the anchor, are compared with those of the other suffixes of the same gram.

Null texts are empty; shorter texts than ``length`` lose nothing. A string repeated within one text counts, and so do repeated
rows. Rows without doc_id take part like others. An empty table gives an empty result. Columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.llm import windows
from clickweave.llm.windows import Kind

LENGTH = 200
GRAM = 50
#: Bytes of one front-coded run.
RUN_BYTES = 1 << 20
_HEAD = struct.Struct("<HHHqq?")  # shared prefix, rest, bytes before the anchor, document, span, met once


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step, at = 16, known
    while a[at:at + step] == b[at:at + step]:
        at += step
    while a[at] == b[at]:
        at += 1
    return at


def front_coded(entries: list[tuple[bytes, bytes, int, int, bool]], most: int = RUN_BYTES) -> Iterator[bytes]:
    """Sorted runs of (suffix, bytes before it, document, span, alone)."""
    out, size, last = [], 0, b""
    for suffix, before, doc, span, alone in sorted(entries):
        shared = common_prefix(last, suffix)
        out.append(_HEAD.pack(shared, len(suffix) - shared, len(before), doc, span, alone))
        out += suffix[shared:], before
        size += _HEAD.size + len(suffix) - shared + len(before)
        last = suffix
        if size >= most:
            yield b"".join(out)
            out, size, last = [], 0, b""
    if out:
        yield b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """(prefix shared with the one before, suffix, payload) of each suffix of a run."""
    at, last = 0, b""
    while at < len(run):
        shared, rest, before, doc, span, alone = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        last = last[:shared] + run[at:at + rest]
        at += rest
        yield shared, last, (run[at:at + before], doc, span, alone)
        at += before


def merge_runs(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Merges sorted runs of (prefix shared with the one before, string, payload) into one of the same form.

    ``losers[i]`` is the run that lost at inner node i. Every run's current string knows the prefix it shares with the string
    put out last, or, at a loser, with the winner that went past it; both are the same string once that winner is put out.
    """
    k = len(runs)
    done = (0, b"", ())
    current: list[tuple[int, bytes, tuple]] = [next(run, done) for run in runs]
    alive = [bool(c[2]) for c in current]
    current = [(0, c[1], c[2]) for c in current]
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's shared prefix then refers to the winner."""
        if not alive[a]:
            return b, a
        if not alive[b]:
            return a, b
        known_a, known_b = current[a][0], current[b][0]
        if known_a > known_b:
            return a, b
        if known_b > known_a:
            return b, a
        x, y = current[a][1], current[b][1]
        shared = common_prefix(x, y, known_a)
        if x[shared:shared + 1] <= y[shared:shared + 1]:
            current[b] = (shared, y, current[b][2])
            return a, b
        current[a] = (shared, x, current[a][2])
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while k and alive[winner]:
        yield current[winner]
        following = next(runs[winner], done)
        current[winner], alive[winner] = following, bool(following[2])
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(losers[node], winner)
            node //= 2


def _ranges(places: list[int]) -> Iterator[tuple[int, int]]:
    """Ascending numbers as stretches without gaps."""
    start = last = places[0]
    for place in places[1:]:
        if place != last + 1:
            yield start, last
            start = place
        last = place
    yield start, last


def _resolve(group: list[tuple[int, bytes, tuple]], bounds: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(document, span, low, high) of the repeated strings of suffixes that share a gram.

    ``bounds``: for each suffix the longest prefix that it shares with any other. A string that starts ``back`` bytes before the
    anchor needs ``length - back`` of them.
    """
    owner: dict[bytes, int] = {}  # -1: met twice
    strings: list[list[tuple[int, bytes]]] = []
    for i, ((_, suffix, (before, _, _, alone)), bound) in enumerate(zip(group, bounds, strict=True)):
        whole = before + suffix
        last = min(len(before) + bound, len(whole)) - length
        own = [(place, whole[place:place + length]) for place in range(last + 1)]
        strings.append(own)
        for _, string in own:
            owner[string] = -1 if not alone or string in owner else i
    for own, (_, _, (_, doc, span, alone)) in zip(strings, group, strict=True):
        if alone:
            places = [place for place, string in own if owner[string] < 0]
            if places:
                for low, high in _ranges(places):
                    yield doc, span, low, high


def _code_runs(kind: Kind, shards: int):
    def run(batches):
        for batch in batches:
            for o in windows.open_spans(batch, kind):
                a, data = o.piece.anchors, o.piece.chunk.data
                by_shard: dict[int, list] = {}
                for doc, anchor, alone, hot in zip(o.doc.tolist(), o.anchor.tolist(), o.alone.tolist(), o.hot.tolist(), strict=True):
                    if not hot:
                        at = int(a.at[anchor])
                        by_shard.setdefault(int(a.gram_hash[anchor]) % shards, []).append((
                            data[at:a.high[anchor] + kind.length].tobytes(), data[a.low[anchor]:at].tobytes(), doc, int(a.span_hash[anchor]), alone))
                coded = [(shard, coded) for shard, entries in by_shard.items() for coded in front_coded(entries)]
                if coded:
                    yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in coded], pa.int32()), pa.array([c[1] for c in coded], pa.binary())],
                                                     names=["shard", "run"])

    return run


def _merge_shard(kind: Kind):
    def run(key, table):
        found = []
        merged = merge_runs([read_run(coded) for coded in table.column("run").to_pylist()])
        group: list = []
        for entry in merged:
            if group and entry[0] < kind.gram:
                found += _resolve(group, _neighbour_bounds(group), kind.length)
                group = []
            group.append(entry)
        if group:
            found += _resolve(group, _neighbour_bounds(group), kind.length)
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["doc", "span", "low", "high"])

    return run


def _neighbour_bounds(group: list) -> list[int]:
    """For each of the sorted suffixes the prefix shared with the nearer neighbour."""
    shared = [0] + [entry[0] for entry in group[1:]] + [0]
    return [max(a, b) for a, b in zip(shared, shared[1:], strict=False)]


def repeated_strings(texts: DataFrame, kind: Kind) -> DataFrame:
    def compare(opened: DataFrame, shards: int) -> DataFrame:
        runs = opened.mapInArrow(_code_runs(kind, shards), "shard int, run binary")
        return runs.groupBy("shard").applyInArrow(_merge_shard(kind), "doc long, span long, low long, high long")

    return windows.repeated_windows(texts, kind, "suffixes", compare)


def remove_repeated(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    kind = Kind(length, gram, words=False, ordered=False)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("doc"), text.alias("text"),
                             F.col("doc_id").cast("long").alias("doc_id"))
    repeated = repeated_strings(texts.select("doc", "text"), kind)

    def cut(batches):
        for batch in batches:
            values = batch.column(1).to_pylist()
            n_removed, n_spans, kept = [], [], []
            for row, mask in windows.removed_units(batch, kind, 1, 3):
                value = values[row]
                if mask is None:
                    n_removed.append(0)
                    n_spans.append(0)
                    kept.append(value)
                else:
                    n_removed.append(int(mask.sum()))
                    n_spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                    kept.append(np.frombuffer(value, np.uint8)[~mask].tobytes())
            sizes = pa.array([len(value) for value in values], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), sizes, pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return windows.with_removals(texts, repeated).mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


