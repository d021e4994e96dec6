"""Token counts: texts are encoded in batches inside an Arrow function and only the lengths come back.

Batches hold about the same number of bytes. Long texts are cut where no piece of the vocabulary can lie across the cut,
so the counts of the parts add up to the count of the whole text. For a vocabulary in which the space mark only opens a
piece, every change from a visible character to a space is such a place; the mark that the encoder puts before each part
stands for the space that was there. Words met again are not encoded again: the parts are counted through a memory
of bounded size.

Null and empty texts have no tokens. Repeated rows are counted each. An empty table gives an empty result.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text encoded together, and parts kept in a worker's memory.
BATCH_BYTES = 1 << 20
MEMORY = 500_000
LONGEST_KEPT = 64
MARK = "▁"


class PieceCounter:
    """Lengths of encodings by one sentencepiece model, without begin and end tokens."""

    def __init__(self, model_file: str, memory: int = MEMORY):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.splits = self._only_opens_pieces()
        self.memory = memory
        self.known: dict[str, int] = {}

    def _only_opens_pieces(self) -> bool:
        """Whether spaces are kept as they are, each text gets a mark in front, and no piece has a mark after another sign."""
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        plain = all(MARK not in piece.lstrip(MARK) for piece in pieces)
        probe = "".join(self.model.id_to_piece(i) for i in self.model.encode(" a  é "))
        return plain and probe.startswith(MARK * 2) and probe.endswith(MARK)

    def _encoded(self, parts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(parts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self._encoded(texts)
        known = self.known
        if len(known) > self.memory:
            known.clear()
        cut = [parts_of(text) for text in texts]
        new = list(set().union(*cut).difference(known))
        known.update(zip(new, self._encoded(new), strict=True))
        counted = [sum(map(known.__getitem__, parts)) for parts in cut]
        for part in new:
            if len(part) > LONGEST_KEPT:
                del known[part]
        return counted


def parts_of(text: str) -> list[str]:
    """``text`` cut at each change from a visible character to a space; that one space is left out."""
    if not text:
        return []
    if MARK in text:  # the mark itself stands in the text, as good as a space: not cut
        return [text]
    parts = text.split(" ")
    if "" not in parts:
        return parts
    # A run of spaces belongs to the word behind it, less the one that the encoder adds.
    joined, spaces = [], 0
    for i, part in enumerate(parts):
        if part == "" and i:
            spaces += 1
        else:
            joined.append(" " * spaces + part)
            spaces = 0
    joined[-1] += " " * spaces
    if parts[0] == "" and len(joined) > 1:  # the text opens with spaces: no visible character stands before them
        joined[:2] = [" " + joined[1]]
    return joined


def balanced(n_bytes: list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of neighbouring texts of at most ``most`` bytes together; a longer text is one by itself."""
    start, size = 0, 0
    for i, n in enumerate(n_bytes):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if n_bytes:
        yield start, len(n_bytes)


_COUNTERS: dict[str, PieceCounter] = {}


def _counter(model_file: str) -> PieceCounter:
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PieceCounter(model_file)
    return _COUNTERS[model_file]


def token_counts(documents: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit. ``model_file`` is there on every executor."""

    def encode(batches):
        counter = _counter(model_file)
        for batch in batches:
            ids, texts = batch.column(0), [text or "" for text in batch.column(1).to_pylist()]
            n_tokens: list[int] = []
            for start, end in balanced(batch.column(2).to_pylist()):
                n_tokens += counter.counts(texts[start:end])
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(2), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = sized.mapInArrow(encode, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
