"""Document fingerprints (SimHash). DataFrame functions only.

Every word votes on each of 128 bits by its hash, with a weight by its length, as short words are the common ones; the sign
of the sum is the bit. Votes for two bits are added up in one 64-bit number. Texts with the same words get the same fingerprint;
the share of equal bits follows the angle between the word weights. ``near_fingerprints`` finds all pairs of fingerprints
within a Hamming radius through permuted block tables.

``edited_fingerprints`` compares each document with its edited text and with the next document. Documents are put into
buckets of neighbouring ids that hold about ``BUCKET_ROWS`` rows, so the text of the next document is at hand inside a bucket;
the first document of each bucket is handed to the bucket before.

Null texts count as empty. A text without words has the fingerprint of all zeros. Rows are ordered by doc_id, nulls last, then
text; repeated rows are separate documents. A single row is its own next document. An empty table gives an empty result.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x20\x09-\x0D]+"
BITS = 128
MOST_WEIGHT = 8
BUCKET_ROWS = 64
#: Quantiles of doc_id that bound the coarse ranges; each is cut into equal buckets.
RANGES = 256
_LANES = 0x100000001


def _weight(word: Column) -> Column:
    return F.when(word == "", F.lit(0)).otherwise(F.least(F.greatest(F.char_length(word) - 2, F.lit(1)), F.lit(MOST_WEIGHT))).cast("long")


def fingerprint_votes(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with the 64-bit halves ``h0`` and ``h1`` of each text's fingerprint; ``keys`` tell the rows apart."""
    word = F.col("_word")
    exploded = texts.select(*keys, F.explode(F.split(F.col(text), SEPARATORS)).alias("_word")).select(
        *keys, _weight(word).alias("_weight"), F.xxhash64(word).alias("_h0"), F.xxhash64(word, F.lit(1)).alias("_h1"))
    votes = [F.sum(F.col("_weight") * F.shiftright(F.col(f"_h{half}"), i).bitwiseAND(F.lit(_LANES))).alias(f"_v{half}_{i}")
             for half in (0, 1) for i in range(32)]
    summed = exploded.groupBy(*keys).agg(F.sum("_weight").alias("_all"), *votes)

    def sign(half: int) -> Column:
        bits = F.lit(0).cast("long")
        for i in range(32):
            v = F.col(f"_v{half}_{i}")
            low, high = v.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(v, 32)
            bits = bits.bitwiseOR(F.when(2 * low > F.col("_all"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
            upper = (1 << (i + 32)) if i < 31 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(2 * high > F.col("_all"), F.lit(upper)).otherwise(F.lit(0)).cast("long"))
        return bits

    return summed.select(*keys, sign(0).alias("h0"), sign(1).alias("h1"))


def fingerprint_text(h0: Column, h1: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h0), 16, "0"), F.lpad(F.hex(h1), 16, "0")))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Share of equal bits."""
    return 1 - distance(a0, a1, b0, b1) / F.lit(float(BITS))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def simhash(documents: DataFrame) -> DataFrame:
    """doc_id, h0, h1 for each distinct (doc_id, text)."""
    texts = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = texts.withColumn("_sha", F.sha2(F.col("text").cast("binary"), 256)).dropDuplicates(["doc_id", "_sha"])
    return fingerprint_votes(keyed, ["doc_id", "_sha"]).select("doc_id", "h0", "h1")


def near_fingerprints(prints: DataFrame, radius: int = 3, spare: int = 2) -> DataFrame:
    """Pairs a0, a1, b0, b1 (a before b) of different fingerprints at most ``radius`` bits apart, with their distance.

    The bits are cut into ``radius + spare`` blocks. Two fingerprints within the radius agree on ``spare`` blocks at least, so
    with one table for each choice of that many blocks, keyed by them, every such pair meets in a table.
    Equal fingerprints are one row; documents are told by joining on h0 and h1.
    """
    n = radius + spare
    edges = [round(i * BITS / n) for i in range(n + 1)]

    def block(i: int) -> Column:
        parts = []
        for half in (0, 1):
            start, end = max(edges[i] - 64 * half, 0), min(edges[i + 1] - 64 * half, 64)
            if start < end:
                mask = ((1 << (end - start)) - 1) << start
                parts.append(F.col(f"h{half}").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)))
        return F.struct(*[part.alias(f"p{j}") for j, part in enumerate(parts)])

    distinct = prints.select("h0", "h1").distinct()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(*[block(i) for i in chosen]).alias("key"))
                       for t, chosen in enumerate(combinations(range(n), spare))])
    keyed = distinct.select("h0", "h1", F.explode(tables).alias("e")).select("h0", "h1", "e.t", "e.key")
    a, b = keyed.alias("a"), keyed.alias("b")
    apart = distance(F.col("a.h0"), F.col("a.h1"), F.col("b.h0"), F.col("b.h1"))
    before = (F.col("a.h0") < F.col("b.h0")) | ((F.col("a.h0") == F.col("b.h0")) & (F.col("a.h1") < F.col("b.h1")))
    return a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & before & (apart <= radius)).select(
        F.col("a.h0").alias("a0"), F.col("a.h1").alias("a1"), F.col("b.h0").alias("b0"), F.col("b.h1").alias("b1"),
        apart.alias("distance")).distinct()


def _ranges(documents: DataFrame) -> tuple[list[int], int]:
    """Bounds of the coarse ranges, and the number of buckets in each."""
    row = documents.select(
        F.percentile_approx("doc_id", [i / RANGES for i in range(RANGES + 1)], 10_000).alias("q"), F.count("doc_id").alias("n")).first()
    bounds = sorted(set(row.q or [0]))
    return bounds, max(1, -(-row.n // (RANGES * BUCKET_ROWS)))


def with_buckets(documents: DataFrame) -> DataFrame:
    """doc_id and text with the bucket's place: ``range`` and ``sub``, both ascending with doc_id."""
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bounds, parts = _ranges(ids)
    number = F.greatest(F.size(F.filter(F.lit(bounds), lambda bound: bound <= F.col("doc_id"))), F.lit(1))
    ranged = ids.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(number))
    low = F.element_at(F.lit(bounds), F.least(F.col("range"), F.lit(len(bounds))))
    high = F.element_at(F.lit(bounds), F.least(F.col("range") + 1, F.lit(len(bounds))))
    width = F.greatest(F.ceil((high.cast("double") - low.cast("double")) / parts), F.lit(1).cast("long"))
    sub = F.floor((F.col("doc_id").cast("double") - low.cast("double")) / width)
    return ranged.withColumn("sub", F.greatest(F.coalesce(sub, F.lit(0)), F.lit(0)).cast("long"))


def _next_buckets(placed: DataFrame) -> DataFrame:
    """Each bucket with the one behind it that has rows; behind the last comes the first."""
    buckets = placed.select("range", "sub").distinct()
    ranges = buckets.groupBy("range").agg(F.min("sub").alias("first_sub"))
    order = Window.partitionBy(F.lit(0)).orderBy("range")  # at most RANGES + 1 rows
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.struct("range", "first_sub")
    after = ranges.select("range", F.coalesce(F.lead(head).over(order), F.first(head).over(whole)).alias("after"))
    inside = F.lead("sub").over(Window.partitionBy("range").orderBy("sub"))
    return buckets.select("range", "sub", inside.alias("inside")).join(after, "range").select(
        "range", "sub", F.when(F.col("inside").isNull(), F.col("after.range")).otherwise(F.col("range")).alias("next_range"),
        F.coalesce("inside", "after.first_sub").alias("next_sub"))


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    bucket = ["range", "sub"]
    placed = with_buckets(documents)
    order = Window.partitionBy(*bucket).orderBy(F.col("doc_id").asc_nulls_last(), "text")
    numbered = placed.select("*", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("behind"))
    firsts = numbered.where(F.col("at") == 1).select(
        F.col("range").alias("next_range"), F.col("sub").alias("next_sub"), F.col("text").alias("first_text"))
    handed = _next_buckets(placed).join(firsts, ["next_range", "next_sub"]).select(*bucket, "first_text")
    last = F.col("behind").isNull()
    paired = numbered.join(handed, bucket, "left")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    following = F.coalesce("behind", "first_text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(following, F.lit(1), cut))
    rows = paired.select(*bucket, "at", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"),
                         F.when(last, F.col("first_text")).alias("outside"))
    key = [*bucket, "at", "doc_id", "n_chars", "edited_sha256"]
    texts = rows.select(*key[:-1], F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        F.stack(F.lit(3), F.lit(0), F.col("text"), F.lit(1), F.col("edited"), F.lit(2), F.col("outside"))
                        .alias("which", "body")).where(F.col("body").isNotNull())
    voted = fingerprint_votes(texts, [*key, "which"], "body")
    halves = [F.max(F.when(F.col("which") == which, F.col(f"h{half}"))).alias(f"{name}{half}")
              for which, name in ((0, "own"), (1, "edited"), (2, "outside")) for half in (0, 1)]
    side_by_side = voted.groupBy(*key).agg(*halves)
    by_place = Window.partitionBy(*bucket).orderBy("at")
    following_half = [F.coalesce(F.lead(f"own{half}").over(by_place), F.col(f"outside{half}")).alias(f"next{half}") for half in (0, 1)]
    return side_by_side.select("*", *following_half).select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_text(F.col("own0"), F.col("own1")).alias("fingerprint"),
        fingerprint_text(F.col("edited0"), F.col("edited1")).alias("edited_fingerprint"),
        likeness(F.col("own0"), F.col("own1"), F.col("edited0"), F.col("edited1")).alias("near_edited"),
        likeness(F.col("own0"), F.col("own1"), F.col("next0"), F.col("next1")).alias("near_next"))
