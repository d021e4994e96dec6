"""Near-duplicate classes by SimHash and multi-index hashing. DataFrame functions only.

The fingerprint has 64 bits: a bit is 1 where it is set in more than half of the XXH64 hashes of the text's ``SHINGLE``-word shingles (A-Z
lower-cased, repeats included; with fewer words, of the whole sequence). Two fingerprints link when at most ``RADIUS`` bits differ, and
classes are the components of the links.

Links are found by multi-index hashing. A fingerprint has two segments of 32 bits, and of two linked ones the first or the second
segment differs in one bit at most. Every fingerprint is stored in a table per segment; it asks each table for its own segment and for
those with one bit cleared (of two segments one bit apart, one is the other with a bit cleared), and complete distances are tested
on what the tables hold there.

An entry of a table that holds more than ``HOT`` fingerprints is not compared one by one but indexed again by the rest of the bits: by halves of
the other segment (16 bits, with the ball of radius 1 around each half), and where even then an entry holds more, by all bits: the ball around
the last 16 bits is enumerated and fingerprints are fetched by their whole value. So the work of a fingerprint
has a bound that no group of near copies raises, and no link is lost.

Equal fingerprints are one row of the search. Null and blank texts have the fingerprint zero and are linked like any other. Rows without
doc_id take part; their class is the smallest doc_id reached, null if there is none. Repeated rows are returned each.
Texts of any length are hashed whole. An empty table gives an empty result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.llm.graph import connected_components
from clickweave.llm.shared import materialized

SEPARATORS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHINGLE = 3
BITS, RADIUS = 64, 3
#: An entry with more fingerprints than this is indexed again by further bits.
HOT = 256
_LANES = 0x100000001
_HALF, _QUARTER = BITS // 2, BITS // 4


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _shingles(words: str) -> Column:
    """Structs of ``SHINGLE`` words in a row; the fields behind the end of a shorter text are null."""
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    return F.arrays_zip(*[F.slice(words, i + 1, n).alias(f"w{i}") for i in range(SHINGLE)])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint (long) of every row."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, UPPER.lower())
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                            F.array_remove(F.split(lowered, SEPARATORS), "").alias("words"))
    shingle = F.col("shingle")
    text = F.concat_ws(" ", *[shingle.getField(f"w{i}") for i in range(SHINGLE)])
    hashed = rows.select("row", "doc_id", F.explode_outer(_shingles("words")).alias("shingle")).select(
        "row", "doc_id", F.when(shingle.isNotNull(), F.xxhash64(text)).alias("h"))  # Spark's seed is 42
    # Votes for two bits, 32 apart, are added up in one number.
    votes = [F.sum(F.shiftright("h", i).bitwiseAND(F.lit(_LANES))).alias(f"v{i}") for i in range(_HALF)]
    summed = hashed.groupBy("row", "doc_id").agg(F.count("h").alias("n"), *votes)
    bits = F.lit(0).cast("long")
    for i in range(_HALF):
        low, high = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{i}", _HALF)
        for at, count in ((i, low), (i + _HALF, high)):
            bits = bits.bitwiseOR(F.when(2 * count > F.col("n"), F.lit(_signed(1 << at))).otherwise(F.lit(0)).cast("long"))
    return summed.select("doc_id", bits.alias("fingerprint"))


def fingerprint_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _asked(rows: DataFrame, variants: list[Column]) -> DataFrame:
    """Each row once for every variant that is not null: a struct of the columns to replace or add."""
    return rows.withColumn("v", F.explode(F.array(*variants))).where(F.col("v").isNotNull()).select(
        *[c for c in rows.columns if c not in ("goal", "left")], "v.*")


def _split(asks: DataFrame, stored: DataFrame, keys: list[str], hot: int) -> tuple[DataFrame, DataFrame]:
    """Links found at entries of at most ``hot`` fingerprints, and the asks for fuller ones."""
    sizes = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("held"))
    sized = asks.join(sizes, keys)
    few = sized.where(F.col("held") <= hot).join(stored.withColumnRenamed("fingerprint", "other"), keys)
    return _links(few), sized.where(F.col("held") > hot).drop("held")


def _links(met: DataFrame) -> DataFrame:
    """Pairs a, b of met fingerprints that link. Those with the whole radius left meet both ways round."""
    once = (F.col("left") < RADIUS) | (F.col("fingerprint") < F.col("other"))
    linked = met.where(once & (F.col("fingerprint") != F.col("other")) & (_apart(F.col("fingerprint"), F.col("other")) <= RADIUS))
    return linked.select(F.greatest("fingerprint", "other").alias("a"), F.least("fingerprint", "other").alias("b"))


def near_pairs(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs a, b (b before a) of the distinct fingerprints of ``prints`` (column fingerprint) that link."""
    prints = prints.select("fingerprint").distinct()
    own = F.col("fingerprint")

    # First index: 32-bit segments, own value or one bit cleared.
    variants = []
    for segment in (0, 1):
        variants.append(F.struct(F.lit(segment).alias("segment"), own.alias("goal"), F.lit(RADIUS).alias("left")))
        for i in range(_HALF * segment, _HALF * (segment + 1)):
            bit = F.lit(_signed(1 << i))
            variants.append(F.when(own.bitwiseAND(bit) != 0, F.struct(
                F.lit(segment).alias("segment"), own.bitwiseXOR(bit).alias("goal"), F.lit(RADIUS - 1).alias("left"))))
    low, high = F.col("goal").bitwiseAND(F.lit((1 << _HALF) - 1)), F.shiftrightunsigned("goal", _HALF)
    keyed = _asked(prints, variants).withColumn("key", F.when(F.col("segment") == 0, low).otherwise(high))
    asks = materialized(keyed, "neardup-asks")
    stored = asks.where(F.col("left") == RADIUS).select("segment", "key", "fingerprint")
    found, fuller = _split(asks, stored, ["segment", "key"], hot)
    fuller = materialized(fuller, "neardup-fuller")
    if fuller.isEmpty():
        return found.distinct()

    # Second index, inside full entries: a 16-bit half of the other segment, own value or one bit flipped.
    goal, left, segment = F.col("goal"), F.col("left"), F.col("segment")

    def quarter(value: Column, other_half: Column) -> Column:
        """Half ``other_half`` of the segment that is not the key's."""
        shifts = F.when(segment == 0, F.lit(_HALF)).otherwise(F.lit(0)) + other_half * _QUARTER
        pieces = [F.when(shifts == s, F.shiftrightunsigned(value, s)) for s in range(0, BITS, _QUARTER)]
        return F.coalesce(*pieces).bitwiseAND(F.lit((1 << _QUARTER) - 1))

    def flipped(half: int, mask: int) -> Column:
        """The goal with bits of a half of the other segment turned."""
        return goal.bitwiseXOR(F.when(segment == 0, F.lit(_signed(mask << _HALF + half * _QUARTER))).otherwise(F.lit(mask << half * _QUARTER)))

    variants = [F.struct(F.lit(half).alias("half"), flipped(half, mask).alias("goal"), (left - (1 if mask else 0)).alias("left"))
                for half in (0, 1) for mask in (0, *(1 << i for i in range(_QUARTER)))]
    asks = _asked(fuller, variants).withColumn("sub", quarter(goal, F.col("half")))
    held = fuller.where(left == RADIUS).select("segment", "key", "fingerprint", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    held = held.withColumn("sub", quarter(own, F.col("half")))
    more, fullest = _split(asks, held, ["segment", "key", "half", "sub"], hot)
    fullest = materialized(fullest, "neardup-fullest")
    found = found.union(more)
    if fullest.isEmpty():
        return found.distinct()

    # Last: whole values, by enumerating the ball around the 16 bits that are left.
    masks = [sum(1 << i for i in chosen) for r in range(RADIUS + 1) for chosen in combinations(range(_QUARTER), r)]
    ball = fullest.withColumn("mask", F.explode(F.array(*[F.lit(mask).cast("long") for mask in masks]))).where(F.bit_count("mask") <= left)
    shift = F.when(segment == 0, F.lit(_HALF)).otherwise(F.lit(0)) + (1 - F.col("half")) * _QUARTER
    moved = F.coalesce(*[F.when(shift == s, F.shiftleft("mask", s)) for s in range(0, BITS, _QUARTER)])
    whole = ball.select("fingerprint", "left", goal.bitwiseXOR(moved).alias("other"))
    return found.union(_links(whole.join(prints.withColumnRenamed("fingerprint", "other"), "other"))).distinct()


def near_duplicates(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """A row per document: doc_id, fingerprint (long) and component_id, the smallest doc_id that links reach, itself included."""
    rows = materialized(fingerprints(documents), "neardup-prints")
    firsts = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc"))
    links = materialized(near_pairs(firsts, hot), "neardup-links")
    labels = connected_components(links).withColumnRenamed("node", "fingerprint")
    labelled = firsts.join(labels, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    smallest = labelled.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    classes = labelled.join(smallest, "label").select("fingerprint", "component_id")
    return rows.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")
