"""Best-fit packing of tokenized documents into sequences of at most ``capacity`` tokens.

Lengths are whole numbers up to the capacity, so the whole instance is a count per length: a table whose size depends on the
capacity alone, however many documents there are. On it a plan is made. First the dominance criterion of Martello and
Toth fixes sets that are at least as good as any other use of their largest document: two that fill a sequence
exactly, a document nothing else fits with, and, where no more than one (or two) others can be added, the partners that
no others beat. That is repeated on the shrunk instance until nothing more can be fixed. What is left is packed best-fit in decreasing order:
each document into the fullest sequence that takes it. Sequences with equal room are planned as one group. Every document then looks
its place up by its rank among those of its length.

The plan has a bound that depends on the capacity alone. A fixed set is taken until one of its lengths runs out (or one document of it is
left), so there are at most two for each length; best fit splits at most one group for each length into three.

Null and empty texts are one end token long. Only longer documents than the capacity are cut. A very long text is encoded in stretches
cut at white space, which give the same ids. Repeated rows are packed each; an empty table gives an empty result. Columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickweave.llm.shared import in_arrow, materialized

CAPACITY = 2048
#: Pieces of one length that are numbered together; a length has as many parts as its count asks for.
PART_ROWS = 16_384
#: Bytes of text that are encoded at once.
STRETCH = 1 << 20
#: Words whose ids a worker keeps; longer words are not kept.
MEMORY = 1_500_000
LONGEST_KEPT = 64
_WIDTH = 4  # bytes of an id


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def stretches(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes that end before white space."""
    at = 0
    while len(text) - at > size and (space := _SPACE.search(text, at + size)):
        yield text[at:space.start()]
        at = space.start()
    yield text[at:]


class WordEncoder:
    """Ids, as little-endian bytes, by a tokenizer that never joins signs across ASCII white space."""

    def __init__(self, tokenizer_file: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.memory = memory
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        known = self.known
        if len(known) > self.memory:
            known.clear()
        cut = [text.split() for text in texts]
        new = list(set().union(*cut).difference(known))
        encoded = self.tokenizer.encode_batch_fast([word.decode() for word in new], add_special_tokens=False)
        known.update((word, array("I", e.ids).tobytes()) for word, e in zip(new, encoded, strict=True))
        ids = [b"".join(map(known.__getitem__, words)) for words in cut]
        for word in new:
            if len(word) > LONGEST_KEPT:
                del known[word]
        return ids

    def rest(self, between: int) -> None:
        """Between tasks no more than this many words stay."""
        if len(self.known) > between:
            self.known.clear()


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def _encoder(tokenizer_file: str, memory: int) -> WordEncoder:
    if (tokenizer_file, memory) not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        _ENCODERS[tokenizer_file, memory] = WordEncoder(tokenizer_file, memory)
    return _ENCODERS[tokenizer_file, memory]


def token_pieces(documents: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0,
                 at_once: int = 256, memory: int = MEMORY, between: int | None = None) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: each document's ids and an end id, cut at the capacity.

    A worker keeps the ids of ``memory`` words, and of ``between``, if given, from a task to the next.
    """
    step = capacity * _WIDTH

    def some(batch) -> Iterator[list[tuple[int, bytes]]]:
        """The batch's rows, as many at once as hold no more than a stretch of text."""
        rows, size = [], 0
        for doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            if rows and (len(rows) == at_once or size + len(text or b"") > STRETCH):
                yield rows
                rows, size = [], 0
            rows.append((doc_id, text or b""))
            size += len(text or b"")
        if rows:
            yield rows

    def cut(batches):
        encoder, end = _encoder(tokenizer_file, memory), end_id.to_bytes(_WIDTH, "little")
        for batch in batches:
            for part in some(batch):
                rows = []
                texts = [text for _, text in part]
                if len(texts) == 1:
                    encoded = [b"".join(encoder.encode([stretch])[0] for stretch in stretches(texts[0]))]
                else:
                    encoded = encoder.encode(texts)
                for (doc_id, _), ids in zip(part, encoded, strict=True):
                    ids += end
                    for i, start in enumerate(range(0, len(ids), step)):
                        piece = ids[start:start + step]
                        rows.append((doc_id, i, start // _WIDTH, len(piece) // _WIDTH, zlib.crc32(piece)))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.rest(memory if between is None else between)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return in_arrow(texts, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Left:
    """The lengths still to be packed: counts, and the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {size: n for size, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)

    def largest_fitting(self, room: int, used: dict[int, int] | None = None) -> int | None:
        """The largest length up to ``room`` of which more are left than ``used``."""
        i = bisect_right(self.sizes, room) - 1
        while i >= 0:
            size = self.sizes[i]
            if self.counts[size] > (used or {}).get(size, 0):
                return size
            i -= 1
        return None

    def smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest documents left beside one of length ``without``."""
        found: list[int] = []
        for size in self.sizes:
            found += [size] * min(n - len(found), self.counts[size] - (size == without))
            if len(found) == n:
                break
        return found

    def take(self, filling: dict[int, int], times: int) -> None:
        for size, n in filling.items():
            self.counts[size] -= n * times
            if not self.counts[size]:
                del self.counts[size]
                self.sizes.pop(bisect_right(self.sizes, size) - 1)

    def possible(self, filling: dict[int, int]) -> int:
        return min(self.counts[size] // n for size, n in filling.items())


def _filling(*sizes: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for size in sizes:
        out[size] = out.get(size, 0) + 1
    return out


def _largest_pair(left: _Left, room: int, beside: int, above: int) -> int:
    """The largest sum, up to ``room``, of two documents longer than ``above`` that are left beside one of length ``beside``."""
    best = 0
    for first in left.sizes[bisect_right(left.sizes, above):]:
        if 2 * first > room:
            break
        used = _filling(beside, first)
        if left.counts[first] < used[first]:
            continue
        second = left.largest_fitting(room - first, used)
        if second is not None and second > above:
            best = max(best, first + second)
    return best


def dominating_set(left: _Left, size: int, capacity: int) -> dict[int, int] | None:
    """A filling with ``size`` that no other filling with ``size`` beats, if one of the criteria proves it.

    What proves it stays true when documents are taken away, as long as the filling's own are there: the shortest left only get longer, and
    the pairs left fewer. So a filling may be taken as often as its documents allow.
    """
    room = capacity - size
    partner = left.largest_fitting(room, _filling(size))
    if partner is None:
        return _filling(size)
    if partner == room:
        return _filling(size, partner)
    small = left.smallest(3, size)
    if len(small) < 2 or small[0] + small[1] > room:
        return _filling(size, partner)
    if len(small) < 3 or sum(small) > room:
        # At most two others: of a pair the longer is no longer than the partner; the shorter must be no longer than the third,
        # or both together no longer than the partner.
        third = left.largest_fitting(room - partner, _filling(size, partner))
        if _largest_pair(left, room, size, third or 0) <= partner:
            return _filling(size, partner, third) if third else _filling(size, partner)
    return None


def fix_dominating(left: _Left, capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fillings, and how often each, that some best packing holds. They are taken off ``left``; again until nothing can be fixed."""
    changed = True
    while changed:
        changed = False
        for size in sorted(left.counts, reverse=True):
            while size in left.counts and (filling := dominating_set(left, size, capacity)) is not None:
                times = left.possible(filling)
                left.take(filling, times)
                changed = True
                yield filling, times


def best_fit(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Best fit in decreasing order, by groups of sequences with the same filling.

    A sequence that has just taken a document is the fullest that can take the next one of that length, so it takes as many as it can.
    """
    rooms: list[int] = []
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(room: int, filling: dict[int, int], times: int) -> None:
        if times:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((filling, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                filling, times = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, filling, times = capacity, {}, n
            each = min(room // size, n)
            full = min(times, n // each)
            n -= full * each
            put(room - each * size, filling | {size: each}, full)
            rest = min(n, each - 1) if full < times else 0
            if rest:
                put(room - rest * size, filling | {size: rest}, 1)
            n -= rest
            if filling:
                put(room, filling, times - full - bool(rest))
    for room in rooms:
        yield from groups[room]


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fillings {length: how many} and how often each is used; together they hold every document once. Equal fillings are one entry."""
    left = _Left(counts)
    used: Counter[tuple[tuple[int, int], ...]] = Counter()
    for filling, times in (*fix_dominating(left, capacity), *best_fit(left.counts, capacity)):
        used[tuple(sorted(filling.items(), reverse=True))] += times
    return [(dict(filling), times) for filling, times in used.items()]


def _places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, per sequence, first sequence, first offset) for every length of every filling."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for size, n in filling.items():
            first = used.get(size, 0)
            used[size] = first + n * times
            rows.append((size, first, used[size], n, sequence, offset))
            offset += size * n
        sequence += times
    return rows


def _small_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A table of a known size, so that it is broadcast only if Spark's own size limit allows."""
    names = [column.split()[0] for column in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, columns, strict=True)}), schema)


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """``pieces`` with sequence_id and offset. The counts by length (at most ``capacity`` rows) are planned on the driver."""
    spark = pieces.sparkSession
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    places = _small_table(
        spark, "length long, first_rank long, end_rank long, per_sequence long, first_sequence long, first_offset long",
        _places(pack_lengths(counts, capacity)))
    parts = _small_table(spark, "length long, parts long", [(size, -(-n // part_rows)) for size, n in counts.items()])
    group = ["length", "part"]
    parted = pieces.join(parts, "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    along = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).select(
        *group, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    order = Window.partitionBy(*group).orderBy("doc_id", "piece", "ids_crc32")
    ranked = parted.withColumn("at", F.row_number().over(order) - 1).join(starts, group) \
        .withColumn("rank", F.col("before") + F.col("at"))
    turn = F.col("rank") - F.col("first_rank")
    placed = ranked.join(places, "length").where(
        (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(turn / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (turn % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(documents: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0,
                   memory: int = MEMORY, between: int | None = None) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``memory`` and ``between`` as in token_pieces."""
    pieces = materialized(token_pieces(documents, tokenizer_file, capacity, end_id, memory=memory, between=between), "pieces")
    return best_fit_pack(pieces, capacity)
