"""Phrase collocations, mined the SETM way: sorted occurrence relations, joined with themselves by piece and next position.

Texts (A-Z lower-cased) are split at ``.,;:!?`` and line breaks into pieces, and these at spaces and tabs into words. The relation R1
has an occurrence for every word, in order, with places that leave a gap behind each piece. Two neighbouring occurrences of length k make one of
length k + 1; its group is counted over the corpus per language, and only occurrences of frequent groups are written out as the next relation
(the semi-join), in order as before. A phrase occurs no more often than its parts, so no frequent phrase is missed. Groups of three words and more
are first counted by buckets of their hashes (Park, Chen and Yu's filter), which move as compact blocks; only groups in buckets that hold enough
occurrences, as those of all frequent groups do, are counted one by one.

A row of a relation is a part: about ``PART_BYTES`` of texts of one language; a longer text is cut into parts that
overlap by what a phrase can reach, and an occurrence counts where it starts. Group counts are added up per part before they move. The frequent groups
reach the tasks as one sorted array as long as there are at most ``SHIPPED`` of them (8 bytes each), and as a list per part,
through a join, beyond.

Scores are exact (decimal numbers of 38 digits). Groups are told apart by 64-bit hashes of words and of pairs of groups, taken as free of
collisions.

Null texts count as empty, a null language as ``und``. Repeated rows count each. Ties are broken by count, then by the phrase. An empty table gives
an empty result. Columns other than the text and the language are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, count, groupby, takewhile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickweave.llm.bytescan import Hashes, mixed
from clickweave.llm.shared import arrow_batches, materialized

NO_LANGUAGE = "und"
BLANKS = b" \t"
PIECE_ENDS = b".,;:!?\n\v\f\r"
PART_BYTES = 1 << 18
#: Size of the batches in which texts and parts reach the tasks.
BATCH = "4m"
CODEC = "zstd"
#: About so many parts are looked at first for an occurrence of each frequent phrase, in one task; each further turn has ``FURTHER`` times as many.
LOOKED_AT_FIRST, FURTHER = 64, 4
#: Most groups that are sent to every task at once (16 bytes each at most); more are joined to the parts.
SHIPPED = 2_000_000
#: Occurrences whose groups are counted together before they leave a task.
TALLIED = 1 << 22
#: Buckets of the filter per occurrence and least count, so that a bucket seldom holds enough by chance; fewest and most bits of their number.
BUCKETS, BUCKET_BITS = 8, (16, 28)
#: Buckets of the filter that move and are added up together.
BLOCK = 1 << 16
#: Pieces into which the phrases of a language are dealt before its leaders are taken.
DEALS = 256
_SPACE = re.compile(rb"[ \t\n\v\f\r]")
_KIND = np.zeros(256, np.uint8)  # 0: part of a word
_KIND[list(BLANKS)] = 1
_KIND[list(PIECE_ENDS)] = 2
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_WORDS = "part long, lang string, own long, n long, at binary, code binary, groups binary, words binary"
_RELATION = "part long, own long, at binary, grp binary"
_SEEN = ("part", "own", "at", "code", "groups")  # what the mining itself reads of the word relation
_GROUPS = "grp long, n long, part long"
_COUNTED = "block long, low binary, n binary"
_BUSY = "block long, busy binary"
_HOMES = "size long, grp long, part long"
_PHRASES = "grp long, lang string, phrase string, heads array<long>, tails array<long>"


class Part(NamedTuple):
    """Texts of one language, end to end; words that start at ``own`` or behind are there to be looked at only."""

    lang: str
    data: bytes
    own: int


def stretches(text: bytes, most: int, reach: int) -> Iterator[tuple[bytes, int]]:
    """A text in stretches of about ``most`` bytes that begin at words, each followed by ``reach`` words of the next, and its own length."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, min(start + most, len(text)))
        end = cut.start() if cut else len(text)
        ahead = re.compile(rb"(?:[ \t\n\v\f\r]+[^ \t\n\v\f\r]+){0,%d}" % reach).match(text, end)
        yield text[start:ahead.end()], end - start
        start = end


def parts_of(texts: pa.Array, langs: pa.Array, longest: int, most: int = PART_BYTES) -> Iterator[Part]:
    langs = pc.fill_null(langs, NO_LANGUAGE)
    for lang in pc.unique(langs).to_pylist():
        held, size = [], 0
        for text in texts.filter(pc.equal(langs, lang)):
            text = text.as_py()
            if not text:
                continue
            if len(text) > most:
                for data, own in stretches(text, most, longest):
                    yield Part(lang, data, own)
                continue
            if size + len(text) > most:
                yield Part(lang, b"\n".join(held), size + len(held))
                held, size = [], 0
            held.append(text)
            size += len(text)
        if held:
            yield Part(lang, b"\n".join(held), size + len(held))


def word_occurrences(part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Starts of the words, their places (with a gap behind each piece), their groups, and the lower-cased bytes with the ends."""
    data = np.frombuffer(part.data.lower(), np.uint8)  # of bytes: A-Z only
    kind = _KIND[data]
    edges = np.diff((kind == 0).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    pieces = np.cumsum(kind == 2)[starts] if len(starts) else np.zeros(0, np.int64)
    at = np.arange(len(starts)) + np.cumsum(np.diff(pieces, prepend=pieces[:1]) > 0)
    language = np.uint64(int.from_bytes(hashlib.blake2b(part.lang.encode(), digest_size=8).digest(), "little"))
    return starts, ends, at.astype(np.int64), mixed(Hashes(data).of(starts, ends) ^ language).astype(np.int64)


def pair_group(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The group of a phrase whose part without the last word and part without the first have these groups."""
    return mixed(mixed(left.astype(np.uint64) * _LEFT) + right.astype(np.uint64) * _RIGHT).astype(np.int64)


def joined(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merge join of a sorted relation with itself on the next place: occurrences one word longer, sorted as well."""
    meet = np.flatnonzero(np.diff(at) == 1)
    return at[meet], pair_group(group[meet], group[meet + 1])


def among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    place = np.searchsorted(sorted_values, values)
    place[place == len(sorted_values)] = 0
    return sorted_values[place] == values if len(sorted_values) else np.zeros(len(values), bool)


def _packed(values: np.ndarray, kind=np.int32) -> bytes:
    return values.astype(kind).tobytes()


def _words(longest: int, most: int):
    """R1 from rows (text, lang): a row per part, places as differences, groups by a dictionary."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in parts_of(batch.column(0), batch.column(1), longest, most):
                starts, ends, at, group = word_occurrences(part)
                if not len(starts):
                    continue
                n = int(np.searchsorted(starts, part.own))
                distinct, first, code = np.unique(group, return_index=True, return_inverse=True)
                lowered = part.data.lower()
                words = b" ".join([lowered[starts[i]:ends[i]] for i in first])
                own = int(at[n]) if n < len(at) else int(at[-1]) + 1
                yield pa.RecordBatch.from_pylist([{
                    "part": task << 32 | number, "lang": part.lang, "own": own, "n": n, "at": _packed(np.diff(at, prepend=0), np.uint8),
                    "code": _packed(code), "groups": _packed(distinct, np.int64), "words": words}], schema=_schema(_WORDS))
                number += 1

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def _occurrences(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places and groups of a row of any relation."""
    at = np.cumsum(np.frombuffer(row["at"], np.uint8 if "code" in row else np.int32), dtype=np.int64)
    if "code" in row:
        return at, np.frombuffer(row["groups"], np.int64)[np.frombuffer(row["code"], np.int32)]
    return at, np.frombuffer(row["grp"], np.int64)


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _kept(row: dict, shipped: Broadcast | None) -> np.ndarray:
    """The frequent groups that a part has to know, sorted."""
    return shipped.value if shipped else np.sort(np.array(row["kept"] or [], np.int64))


def _together(found: Iterator[tuple[dict, np.ndarray, np.ndarray]], most: int) -> Iterator[list]:
    """What is found, in lists of about ``most`` occurrences."""
    held, size = [], 0
    for row, at, group in found:
        held.append((row, at, group))
        size += len(at)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _tallied(found: Iterator[tuple[dict, np.ndarray, np.ndarray]], most: int) -> Iterator[pa.RecordBatch]:
    """Groups with their occurrences, added up over about ``most`` occurrences, or for each part if that is 0 (only then ``part`` has a meaning).

    For each part, what it only looks at is a group with 0 occurrences, so that the list of its frequent groups has it as well.
    """

    def total(held: list) -> pa.RecordBatch:
        part = held[0][0]["part"]
        groups, n = np.unique(np.concatenate([group[at < row["own"]] for row, at, group in held]), return_counts=True)
        if not most:
            ahead = np.setdiff1d(np.concatenate([group[at >= row["own"]] for row, at, group in held]), groups)
            groups, n = np.concatenate([groups, ahead]), np.concatenate([n, np.zeros(len(ahead), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(groups), pa.array(n.astype(np.int64)), pa.array(np.full(len(groups), part))],
                                          schema=_schema(_GROUPS))

    yield from map(total, _together(found, most))


def _count_words(most: int):
    def run(batches):
        yield from _tallied(((row, *_occurrences(row)) for row in _rows(batches)), most)

    return run


def _count_longer(shipped: Broadcast | None, most: int, busy: Broadcast | None = None):
    """Groups one word longer than those of the relation, of which only frequent ones count; those in ``busy`` buckets, if given."""

    def longer(row: dict):
        at, group = _occurrences(row)
        if "code" in row:
            keep = among(group, _kept(row, shipped))
            at, group = at[keep], group[keep]
        at, group = joined(at, group)
        if busy:
            keep = in_busy(group, busy.value)
            at, group = at[keep], group[keep]
        return row, at, group

    def run(batches):
        yield from _tallied(map(longer, _rows(batches)), most)

    return run


def bucket(group: np.ndarray, bits: int) -> np.ndarray:
    return (group.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def in_busy(group: np.ndarray, busy: np.ndarray) -> np.ndarray:
    """Which groups lie in buckets whose bit is set."""
    at = bucket(group, (len(busy) * 8).bit_length() - 1)
    return (busy[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _count_buckets(bits: int, least: int, most: int):
    """Occurrences one word longer than those of the relation by buckets: for each block the buckets that have any, and their counts up to ``least``."""

    def blocks(held: list) -> pa.RecordBatch:
        full, n = np.unique(np.concatenate([bucket(group[at < row["own"]], bits) for row, at, group in held]), return_counts=True)
        low, n = (full % BLOCK).astype(np.uint16), np.minimum(n, least).astype(np.min_scalar_type(least))
        numbers, first = np.unique(full // BLOCK, return_index=True)
        ends = np.append(first, len(full))[1:]
        pieces = [pa.array([values[i:k].tobytes() for i, k in zip(first, ends, strict=True)], pa.binary()) for values in (low, n)]
        return pa.RecordBatch.from_arrays([pa.array(numbers), *pieces], schema=_schema(_COUNTED))

    def run(batches):
        yield from map(blocks, _together(((row, *joined(*_occurrences(row))) for row in _rows(batches)), most))

    return run


def _add_buckets(least: int):
    """The bits of the buckets with ``least`` occurrences and more, from rows of ``_count_buckets`` sorted by block."""

    def run(batches):
        for block, rows in groupby(_rows(batches), lambda row: row["block"]):
            n = np.zeros(BLOCK, np.int64)
            for row in rows:
                n[np.frombuffer(row["low"], np.uint16)] += np.frombuffer(row["n"], np.min_scalar_type(least))
            if (n >= least).any():
                yield pa.RecordBatch.from_pylist([{"block": block, "busy": np.packbits(n >= least).tobytes()}], schema=_schema(_BUSY))

    return run


def _extend(before: Broadcast | None, after: Broadcast | None):
    """The next relation: occurrences one word longer, of frequent groups only."""

    def run(batches):
        for row in _rows(batches):
            at, group = _occurrences(row)
            if "code" in row:
                keep = among(group, _kept(row, before))
                at, group = at[keep], group[keep]
            at, group = joined(at, group)
            keep = among(group, _kept({"kept": row.get("kept_next")}, after))
            at, group = at[keep], group[keep]
            if len(at):
                yield pa.RecordBatch.from_pylist([{"part": row["part"], "own": row["own"], "at": _packed(np.diff(at, prepend=0)),
                                                   "grp": _packed(group, np.int64)}], schema=_schema(_RELATION))

    return run


def _levels(row: dict, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size the groups of all phrases of a part by first word, and which of them lie in one piece."""
    at, group = _occurrences(row)
    for size in range(1, min(longest, len(at)) + 1):
        if size > 1:
            group = pair_group(group[:-1], group[1:])
        yield size, group, at[size - 1:] - at[:len(at) - size + 1] == size - 1


def _find(shipped: Broadcast):
    """A part that has it for each of the shipped groups (sorted arrays by size), once in a task."""

    def run(batches):
        told = {size: np.zeros(len(groups), bool) for size, groups in shipped.value.items()}
        for row in _rows(batches):
            for size, group, whole in _levels(row, max(told)):
                if size not in told:
                    continue
                groups = shipped.value[size]
                here = np.unique(group[whole & among(group, groups)])
                place = np.searchsorted(groups, here)
                new = place[~told[size][place]]
                if len(new):
                    told[size][new] = True
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), size)), pa.array(groups[new]), pa.array(np.full(len(new), row["part"]))],
                                                     schema=_schema(_HOMES))

    return run


def _spell(batches):
    """Phrases of the groups in ``wanted`` (structs size, grp), with the groups of their first and last 1, 2, ... words."""
    for row in _rows(batches):
        words, code = row["words"].split(b" "), np.frombuffer(row["code"], np.int32)
        levels, found = [], []
        for size, group, whole in _levels(row, max(w["size"] for w in row["wanted"])):
            levels.append(group)
            wanted = np.sort(np.array([w["grp"] for w in row["wanted"] if w["size"] == size], np.int64))
            hits = np.flatnonzero(whole & among(group, wanted))
            for i in hits[np.unique(group[hits], return_index=True)[1]].tolist():
                found.append({"grp": int(group[i]), "lang": row["lang"], "phrase": b" ".join([words[c] for c in code[i:i + size]]).decode(),
                              "heads": [int(levels[k][i]) for k in range(size - 1)],
                              "tails": [int(levels[size - 2 - k][i + k + 1]) for k in range(size - 1)]})
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=_schema(_PHRASES))


#: The counted groups of a relation, given over how many occurrences to add up first.
Groups = Callable[[int], DataFrame]


class Mining:
    """The tables that the mining writes out: the word relation, and the frequent groups of each size."""

    def __init__(self, documents: DataFrame, least: int, longest: int, shipped: int, part_bytes: int):
        self.spark, self.least, self.shipped = documents.sparkSession, least, shipped
        texts = documents.select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
        self.words = materialized(texts.mapInArrow(_words(longest, part_bytes), _WORDS), "phrases-words", codec=CODEC)
        relation, before = self.words.select(*_SEEN), None
        self.groups: list[Groups] = [lambda most, r=relation: r.mapInArrow(_count_words(most), _GROUPS)]
        self.frequent = [self._frequent()]
        for size in range(2, longest + 1):
            if size > 2:
                relation = materialized(self._extended(relation, before), f"phrases-{size - 1}", codec=CODEC)
            if size == 2:
                before, busy = self._known(relation, "kept"), None
            else:
                occurrences = self.frequent[-1].agg(F.sum("n")).first()[0] or 0
                before = relation.coalesce(-(-occurrences // TALLIED) or 1), None  # so that much is added up before it moves
                busy = self._busy(before[0], occurrences)
            self.groups.append(lambda most, k=before, busy=busy: k[0].mapInArrow(_count_longer(k[1], most, busy), _GROUPS))
            self.frequent.append(self._frequent())

    def _frequent(self) -> DataFrame:
        totals = self.groups[-1](TALLIED).groupBy("grp").agg(F.sum("n").alias("n"))
        return materialized(totals.where(F.col("n") >= self.least), "phrases-frequent")

    def _busy(self, relation: DataFrame, occurrences: int) -> Broadcast:
        """A bit for each bucket (32 MB of bits at most): whether groups one word longer than the relation's have ``least`` occurrences there together."""
        fewest, most = BUCKET_BITS
        bits = min(max((BUCKETS * occurrences // self.least).bit_length(), fewest), most)
        counted = relation.mapInArrow(_count_buckets(bits, self.least, TALLIED), _COUNTED)
        found = counted.repartition("block").sortWithinPartitions("block").mapInArrow(_add_buckets(self.least), _BUSY).toArrow()
        busy = np.zeros(((1 << bits) // BLOCK, BLOCK // 8), np.uint8)
        for row in found.to_pylist():
            busy[row["block"]] = np.frombuffer(row["busy"], np.uint8)
        return self.spark.sparkContext.broadcast(busy.ravel())

    def _known(self, relation: DataFrame, name: str) -> tuple[DataFrame, Broadcast | None]:
        """The relation whose tasks know the latest frequent groups: as one array, or as a list for each part."""
        frequent = self.frequent[-1].select("grp")
        if frequent.count() <= self.shipped:
            return relation, self.spark.sparkContext.broadcast(np.sort(frequent.toArrow().column(0).to_numpy()))
        lists = self.groups[-1](0).join(frequent, "grp", "left_semi").groupBy("part").agg(F.collect_list("grp").alias(name))
        return relation.join(lists, "part", "left"), None

    def _extended(self, relation: DataFrame, before: tuple[DataFrame, Broadcast | None]) -> DataFrame:
        known, after = self._known(before[0], "kept_next")
        return known.mapInArrow(_extend(before[1], after), _RELATION)

    def _homes(self, few: bool) -> DataFrame:
        """size, grp and a part that has it, for the frequent phrases of two words or more."""
        phrases = list(enumerate(self.frequent[1:], 2))
        if not few:
            found = reduce(DataFrame.union, [self.groups[size - 1](0).join(frequent.select("grp"), "grp", "left_semi").select(
                F.lit(size).cast("long").alias("size"), "grp", "part") for size, frequent in phrases])
            return found.groupBy("size", "grp").agg(F.min("part").alias("part"))
        # Most phrases are met in a few of the parts, and every task tells of each that it meets: few tasks look for all, more only for the rest.
        open_ = {size: np.sort(found.select("grp").toArrow().column(0).to_numpy()) for size, found in phrases}
        *turns, last = self._turns()
        homes = []
        for parts in turns:
            homes.append(materialized(self._look(parts, open_), "phrases-homes"))
            met = homes[-1].select("size", "grp").toArrow().to_pandas()
            open_ = {size: np.setdiff1d(groups, met.grp[met["size"] == size]) for size, groups in open_.items()}
            if not any(map(len, open_.values())):
                return reduce(DataFrame.union, homes)
        return reduce(DataFrame.union, [*homes, self._look(last, open_)])

    def _turns(self) -> list[DataFrame]:
        """The parts dealt by chance: as many as one task looks at, then ``FURTHER`` times as many in as many more tasks and so on; last the other parts."""
        total = self.words.count()
        sizes = list(takewhile(lambda size: size * FURTHER <= total, (LOOKED_AT_FIRST * FURTHER ** i for i in count())))
        if not sizes:
            return [self.words]
        place = F.pmod(F.xxhash64("part"), F.lit(total))
        turn = reduce(Column.__add__, [(place >= end).cast("int") for end in accumulate(sizes)])
        dealt = self.words.select(*_SEEN, turn.alias("turn"))
        first = materialized(dealt.where(F.col("turn") < len(sizes)), "phrases-looked-at", "turn", CODEC)
        return [*(first.where(F.col("turn") == i).coalesce(FURTHER ** i) for i in range(len(sizes))), dealt.where(F.col("turn") == len(sizes))]

    def _look(self, words: DataFrame, groups: dict[int, np.ndarray]) -> DataFrame:
        found = words.select(*_SEEN).mapInArrow(_find(self.spark.sparkContext.broadcast(groups)), _HOMES)
        return found.groupBy("size", "grp").agg(F.min("part").alias("part"))

    def phrases(self) -> DataFrame:
        """Frequent phrases of two words or more: grp, lang, phrase, heads, tails."""
        few = sum(found.count() for found in self.frequent[1:]) <= self.shipped
        wanted = self._homes(few).groupBy("part").agg(F.collect_list(F.struct("size", "grp")).alias("wanted"))  # no more than a part has
        return self.words.join(F.broadcast(wanted) if few else wanted, "part").mapInArrow(_spell, _PHRASES)

    def counts(self) -> DataFrame:
        """grp and n of all frequent phrases and words."""
        return reduce(DataFrame.union, [found.select("grp", "n") for found in self.frequent])


def score(a: str, n: str, l: str, r: str) -> Column:
    """``floor(1000 a n / (l r))``; the products have up to 38 digits."""
    a, n, l, r = (F.col(name).cast("decimal(19,0)") for name in (a, n, l, r))
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * a * n, l * r).cast("long")


def collocations(documents: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, shipped: int = SHIPPED,
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and its first and last part at the cut with the lowest score ``floor(1000 a n / (l r))``, n all words.
    Phrases that stand inside a phrase one word longer each time they occur are left out.
    """
    with arrow_batches(documents.sparkSession, BATCH):
        mined = Mining(documents, least, longest, shipped, part_bytes)
        counts = mined.counts()
        found = materialized(mined.phrases().join(counts.withColumnRenamed("n", "a"), "grp"), "phrases-found")

    inside = found.where(F.size("heads") > 1).select(
        "a", F.explode(F.array(F.element_at("heads", -1), F.element_at("tails", 1))).alias("grp"))
    widest = inside.groupBy("grp").agg(F.max("a").alias("longer"))
    kept = found.join(widest, "grp", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))

    sizes = mined.words.groupBy("lang").agg(F.sum("n").alias("n"))
    cuts = kept.select("grp", "lang", "phrase", "a", F.posexplode(F.arrays_zip("heads", "tails")).alias("cut", "sides")).select(
        "grp", "lang", "phrase", "a", "cut", "sides.heads", "sides.tails")
    sides = cuts.join(counts.select(F.col("grp").alias("heads"), F.col("n").alias("l")), "heads") \
        .join(counts.select(F.col("grp").alias("tails"), F.col("n").alias("r")), "tails").join(sizes, "lang")
    lowest = sides.withColumn("score", score("a", "n", "l", "r")).groupBy("lang", "grp", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    rows = lowest.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")

    order = (F.desc("score"), F.desc("a"), "phrase")
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALS)))
    leading = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = leading.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM words, (SELECT unnest(range(1, 6)) AS k) AS lengths WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
spelled AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
longer AS (
    SELECT lang, sub, max(f) AS f FROM (
        SELECT lang, f, array_to_string(w[1:k - 1], ' ') AS sub FROM spelled WHERE k > 2
        UNION ALL SELECT lang, f, array_to_string(w[2:], ' ') FROM spelled WHERE k > 2) AS inner_parts
    GROUP BY lang, sub),
kept AS (
    SELECT s.* FROM spelled AS s LEFT JOIN longer AS o ON o.lang = s.lang AND o.sub = s.phrase WHERE o.f IS NULL OR o.f < s.f),
cuts AS (
    SELECT lang, phrase, f, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) AS cut_kept),
scored AS (
    SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, s.n, c.cut, (CAST(1000 AS HUGEINT) * c.f * s.n) // (h.f * t.f) AS score
    FROM cuts AS c JOIN counts AS h ON h.lang = c.lang AND h.phrase = c.head
    JOIN counts AS t ON t.lang = c.lang AND t.phrase = c.tail JOIN sizes AS s ON s.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS turn FROM scored),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE turn = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
