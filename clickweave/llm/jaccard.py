"""N-gram Jaccard join by parity sketches, and the components of its links.

A document's set holds the hashes of its distinct shingles of ``width`` words (A-Z lower-cased); with fewer words, of the whole
sequence. Sets A and B link when their Jaccard similarity is at least 4/5, that is, when their symmetric difference D is at most
``(|A| + |B|) / 9``.

Parity sketch: every shingle flips one bit of a sketch, so equal shingles cancel out and two sketches differ in at most D bits.
For joining, the sketch is very wide and sparse, cut into K blocks; a block's key is the XOR of the hashes of its shingles. At
most D blocks differ, so of any D + 1 blocks of A one at least is the same in B. K depends on the size band (powers
of two) and is chosen so that more than D blocks hold two shingles or more; such blocks alone are joined on. A document
near the lower edge of its band is also entered into the band below. Where too few blocks hold two shingles, all blocks that are not empty count, and a
document for which even these are too few is joined on its shingles instead.

Keys that more than ``HOT`` sets have are hot. A set with more than D blocks on other keys leaves its hot keys
out: a partner must meet it elsewhere. The hot keys of the remaining sets (near copies of widespread texts) are kept.

Candidates are first compared with the first set of each key; links found are exact, and sets already in one component are not compared
again. Then sets that share a key but no component are compared with each other. Each candidate pair must
pass a dense parity sketch of 1024 bits, whose Hamming distance bounds D from below, and then the exact test on the texts.

Equal sets are one node (told apart by a 64-bit hash of the set, as shingles are; both are taken as free of collisions).
Null and empty texts have no shingles and no links. Rows without doc_id are returned with a null component. Repeated rows are
returned each. An empty table gives an empty result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickweave.llm import bytescan
from clickweave.llm.graph import connected_components
from clickweave.llm.shared import in_arrow, materialized

WIDTH = 5
#: More sets than this on one key make it hot.
HOT = 64
SKETCH_WORDS = 16
#: Sets whose keys a task remembers to have sent, so copies inside a task are sent once.
REMEMBERED = 200_000
_CLASS, _MEMBER = 0, 1
_UNLUCKY = 1 << 40


def shingle_sets(chunk: bytescan.Chunk, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted shingle hashes of every text of a chunk."""
    lowered = chunk._replace(data=bytescan.lower(chunk.data))
    found = bytescan.words(lowered)
    sequence = bytescan.Hashes(bytescan.word_hashes(lowered, found))
    sets = []
    for start, end in zip(found.bounds[:-1], found.bounds[1:], strict=True):
        starts = np.arange(start, max(start + 1, end - width + 1)) if end > start else np.zeros(0, np.int64)
        sets.append(np.unique(sequence.of(starts, np.minimum(starts + width, end))))
    return sets


def most_apart(n: int, partner: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (n + partner) // 9


def n_blocks(band: int) -> int:
    return max(64, (4 << band) // 5)


def set_id(hashes: np.ndarray) -> int:
    return int(bytescan.mixed(np.array([bytescan.mixed(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0].astype(np.int64))


def dense_sketch(hashes: np.ndarray) -> bytes:
    bits = np.bincount((hashes & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def block_keys(hashes: np.ndarray, band: int, apart: int) -> tuple[np.ndarray, int] | None:
    """The keys to join on in a band and how many of them may be left out; None where the blocks are too few."""
    k = n_blocks(band)
    block = ((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(block, prepend=np.uint64(k)))
    sizes = np.diff(starts, append=len(hashes))
    parity = np.bitwise_xor.reduceat(bytescan.mixed(hashes), starts)
    chosen = sizes >= 2
    if chosen.sum() <= apart:
        chosen = sizes >= 1
        if chosen.sum() <= apart:
            return None
    place = block[starts][chosen] + np.uint64(band << 40)
    return bytescan.mixed(parity[chosen] ^ bytescan.mixed(place)).astype(np.int64), int(chosen.sum()) - apart - 1


def bands_of(n: int) -> list[tuple[int, int]]:
    """(band, largest symmetric difference there) in which a set of this size meets its partners."""
    if n < 4:  # linked sets this small are equal
        return []
    band = n.bit_length() - 1
    found = [(band, most_apart(n, n * 5 // 4))]
    if 4 * n < 5 << band and band > 2:
        found.append((band - 1, most_apart(n, (1 << band) - 1)))
    return found


_ENTRIES = "key long, node long, info long, sketch binary"


def _entries(batches):
    """A class row per document (key doc_id, info -n - 1) and, once per set and task, its keys.

    info of a key: size, 1 bit for the band below, and above them how many keys may be left out. The class row of a set with
    too few blocks says so in its info.
    """
    sent: set[int] = set()
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for chunk in bytescan.chunks(batch.column(1)):
            keys, nodes, infos, sketches, doc_ids, doc_nodes, doc_infos = [], [], [], [], [], [], []
            for i, hashes in enumerate(shingle_sets(chunk)):
                n, node = len(hashes), set_id(hashes)
                doc_ids.append(ids[chunk.first + i])
                doc_nodes.append(node)
                info = -n - 1
                sketch = None
                if node not in sent:
                    if len(sent) < REMEMBERED:
                        sent.add(node)
                    sketch = dense_sketch(hashes) if n > 3 else None
                    for turn, (band, apart) in enumerate(bands_of(n)):
                        found = block_keys(hashes, band, apart)
                        if found is None:
                            info = -n - 1 - _UNLUCKY
                            continue
                        keys.append(found[0])
                        nodes.append(np.full(len(found[0]), node, np.int64))
                        infos.append(np.full(len(found[0]), n | turn << 32 | found[1] << 33, np.int64))
                doc_infos.append(info)
                sketches.append(sketch)
            n_keys = sum(map(len, keys))
            empty = pa.nulls(n_keys, pa.binary())
            columns = [np.concatenate([np.array(own, np.int64), *more]) for own, more in
                       ((doc_ids, keys), (doc_nodes, nodes), (doc_infos, infos))]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.concat_arrays([pa.array(sketches, pa.binary()), empty])],
                names=["key", "node", "info", "sketch"])


_RUNS = "key long, node long, info long, hot boolean, sketch binary, kind int"


def _runs(batches):
    """From rows sorted by key and node: class rows as they are, and the rows of keys that two or more sets have.

    At most ``HOT`` rows of an unfinished key are held back, however long its run is.
    """
    held = np.zeros((3, 0), np.int64)
    hot_key, last = None, None

    def rows(key, node, info, hot, kind, sketch):
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(node), pa.array(info), pa.array(hot), sketch, pa.array(np.full(len(key), kind, np.int32))],
            names=["key", "node", "info", "hot", "sketch", "kind"])

    def none(n):
        return pa.nulls(n, pa.binary())

    for batch in batches:
        info = batch.column(2).to_numpy()
        is_class = info < 0
        if is_class.any():
            part = batch.filter(pa.array(is_class))
            yield rows(*(part.column(i).to_numpy() for i in range(3)), np.zeros(part.num_rows, bool), _CLASS, part.column(3))
        values = np.stack([batch.column(i).to_numpy()[~is_class] for i in range(3)])
        values = np.concatenate([held, values], 1)
        if not values.shape[1]:
            continue
        key, node = values[0], values[1]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        if not held.shape[1] and last == (key[0], node[0]):
            new[0] = False
        last = (key[-1], node[-1])
        values = values[:, new]
        if not values.shape[1]:
            continue
        key = values[0]
        starts = np.flatnonzero(np.diff(key, prepend=~key[0]))
        sizes = np.diff(starts, append=len(key))
        hot = sizes > HOT
        if hot_key is not None and key[0] == hot_key:
            hot[0] = True
        keep = (sizes >= 2) | hot
        if hot[-1]:
            hot_key, held = key[-1], np.zeros((3, 0), np.int64)
        else:
            held, keep[-1] = values[:, starts[-1]:], False
        mask = np.repeat(keep, sizes)
        if mask.any():
            out = values[:, mask]
            yield rows(*out, np.repeat(hot, sizes)[mask], _MEMBER, none(out.shape[1]))
    if held.shape[1] >= 2:
        yield rows(*held, np.zeros(held.shape[1], bool), _MEMBER, none(held.shape[1]))


def _size(info: Column) -> Column:
    return info.bitwiseAND(F.lit((1 << 32) - 1))


def _may_link(n_a: Column, n_b: Column) -> Column:
    return F.least(n_a, n_b) * 5 >= F.greatest(n_a, n_b) * 4


def _word(sketch: str, i: int) -> Column:
    """The i-th eight bytes of a sketch as a number."""
    return F.conv(F.hex(F.substring(sketch, 8 * i + 1, 8)), 16, -10).cast("long")


def _sketches_near(a: str, b: str, n_a: Column, n_b: Column) -> Column:
    """Whether the dense sketches are no further apart than linked sets of these sizes can be."""
    differing = F.lit(0)
    for i in range(SKETCH_WORDS):
        differing = differing + F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}")))
    return differing * 9 <= n_a + n_b


def _sets(texts: pa.Array) -> list[np.ndarray]:
    return [found for chunk in bytescan.chunks(texts) for found in shingle_sets(chunk)]


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets have a Jaccard similarity of 4/5 or more."""

    def test(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                linked = []
                for a, b in zip(_sets(part.column(2)), _sets(part.column(3)), strict=True):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    linked.append(100 * common >= 80 * (len(a) + len(b) - common))
                yield part.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return in_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b"), test, "a long, b long")


def _pairs_of_unlucky(texts: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Pairs of the sets with too few blocks and all sets they share a shingle with; None if there is no such set."""
    unlucky = classes.where(F.col("info") < -_UNLUCKY).select("node").distinct()
    if unlucky.isEmpty():
        return None

    def explode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = _sets(batch.column(0).slice(at, 256))
                nodes = np.repeat(np.array([set_id(s) for s in sets], np.int64), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.array(np.concatenate(sets).astype(np.int64))], names=["node", "h"])

    shingles = in_arrow(texts.select("text"), explode, "node long, h long")
    own = shingles.join(unlucky, "node").withColumnRenamed("node", "a").distinct()
    return own.join(shingles.withColumnRenamed("node", "b"), "h").where(F.col("a") != F.col("b")).select("a", "b").distinct()


def link_components(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included)."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    named = texts.where(F.col("doc_id").isNotNull())
    entries = in_arrow(named, _entries, _ENTRIES)
    found = materialized(in_arrow(entries.repartition("key").sortWithinPartitions("key", "node"), _runs, _RUNS), "runs", "kind")
    classes = found.where(F.col("kind") == _CLASS)
    members = found.where(F.col("kind") == _MEMBER).select("key", "node", "info", "hot")

    # Hot keys count only for sets that have too few others.
    turn, spare = F.shiftright("info", 32).bitwiseAND(F.lit(1)), F.shiftright("info", 33)
    of_set = Window.partitionBy("node", turn)  # no more rows than the set has blocks
    poor = members.where("hot").withColumn("n", F.count(F.lit(1)).over(of_set)).where(F.col("n") > spare)
    kept = members.where(~F.col("hot")).select("key", "node", "info").union(poor.select("key", "node", "info"))
    kept = kept.select("key", "node", _size(F.col("info")).alias("n"))

    sketch = classes.where(F.col("sketch").isNotNull()).groupBy("node").agg(F.first("sketch").alias("sketch"))
    sketches = sketch.select("node", *[_word("sketch", i).alias(f"s{i}") for i in range(SKETCH_WORDS)])
    per_node = materialized(classes.groupBy("node").agg(F.min("key").alias("first_doc"), F.max("info").alias("info")), "nodes")

    first = kept.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"))
    star = kept.join(first, "key").where((F.col("node") != F.col("first.node")) & _may_link(F.col("n"), F.col("first.n"))).select(
        F.col("node").alias("a"), F.col("first.node").alias("b"), F.col("n").alias("n_a"), F.col("first.n").alias("n_b")).distinct()
    near = star.join(sketches.alias("x"), F.col("a") == F.col("x.node")).join(sketches.alias("y"), F.col("b") == F.col("y.node")).where(
        _sketches_near("x", "y", F.col("n_a"), F.col("n_b"))).select("a", "b")
    special = _pairs_of_unlucky(named, classes)
    near = materialized(near if special is None else near.union(special).distinct(), "near")
    links = materialized(_verified(near, _node_texts(named, per_node, near)), "links")
    labels = connected_components(links)

    # Sets that share a key and are not yet in one component.
    labelled = kept.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") < F.col("high")).select("key")
    open_sets = materialized(labelled.join(mixed, "key").join(sketches, "node"), "open")
    x, y = open_sets.alias("x"), open_sets.alias("y")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & _may_link(F.col("x.n"), F.col("y.n"))
                    & _sketches_near("x", "y", F.col("x.n"), F.col("y.n"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    across = materialized(across, "across")
    if not across.isEmpty():
        more = materialized(_verified(across, _node_texts(named, per_node, across)), "links")
        if not more.isEmpty():
            labels = connected_components(links.union(more))

    grouped = per_node.where(F.col("info") < -1).join(labels, "node", "left").select("node", "first_doc", F.coalesce("label", "node").alias("label"))
    component = grouped.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    by_node = grouped.join(component, "label").select("node", "component_id")
    n = -(F.when(F.col("info") < -_UNLUCKY, F.col("info") + _UNLUCKY).otherwise(F.col("info"))) - 1
    rows = classes.select(F.col("key").alias("doc_id"), "node", n.alias("n_shingles"))
    linked = rows.where(F.col("n_shingles") > 0).join(by_node, "node").select("doc_id", "n_shingles", "component_id")
    alone = rows.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).union(_without_id(texts))


def _node_texts(texts: DataFrame, per_node: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and one of its texts, for the nodes of ``pairs``."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = per_node.select("node", F.col("first_doc").alias("doc_id")).join(nodes, "node")

    def matching(batches):
        """Rows that share a doc_id can have different texts: the right one is told by its set, and comes once from a task."""
        seen: set[int] = set()
        for batch in batches:
            keep = []
            for node, found in zip(batch.column(0).to_pylist(), _sets(batch.column(1)), strict=True):
                keep.append(node not in seen and set_id(found) == node)
                if keep[-1]:
                    seen.add(node)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return materialized(in_arrow(texts.join(wanted, "doc_id").select("node", "text"), matching, "node long, text binary"), "texts")


def _without_id(texts: DataFrame) -> DataFrame:
    def count(batches):
        for batch in batches:
            sizes = [len(s) for s in _sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), batch.column(0)], names=["doc_id", "n_shingles", "component_id"])

    return in_arrow(texts.where(F.col("doc_id").isNull()), count, "doc_id long, n_shingles long, component_id long")


def one_of_each_component(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that have their component's smallest doc_id, once for each text; rows without doc_id all stay."""
    links = link_components(documents)
    smallest = links.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept")).distinct()
    # The row is one field, so its columns can have any names.
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    doc_id, text = F.col("row").getField("doc_id"), F.col("row").getField("text")
    named = rows.select("row", doc_id.cast("long").alias("id"), F.xxhash64(text).alias("text_hash")).join(smallest, F.col("id") == F.col("kept"))
    first = Window.partitionBy("id", "text_hash").orderBy("id")
    once = named.withColumn("turn", F.row_number().over(first)).where(F.col("turn") == 1).select("row")
    return once.union(rows.where(doc_id.isNull())).select("row.*")
