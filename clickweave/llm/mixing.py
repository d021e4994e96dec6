"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Each source gets a target of words; every document of a source is expected ``target / size`` times. The expected copies
are summed along the source, one random offset is added, and a document is taken once for every integer boundary that
its stretch crosses. Documents are laid out by size, so large and small ones are drawn evenly and the words taken stay
within about one document of the target.

Null and empty texts have size 0 and take part with 0 words. A null source is a source of its own, ordered last.
Repeated rows are separate documents. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickweave.llm.shared import WORD, materialized

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Parts of one size class of one source that are numbered independently, so no class has to fit into one task.
PARTS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row per source: ``source_size``, ``target``. ``sizes`` holds source and size.

    Targets are the weighted shares of ``share`` times all words, none above ``most`` times its source; what is cut off
    is shared again among the others, so the targets below the cap are one common multiple of the weights. The common
    multiple is read off the sources in the order in which they reach their cap.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weighted = per_source.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                               ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")),
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    all_rows = Window.partitionBy(F.lit(0))
    full_at = F.col("cap") / F.col("weight")
    order = Window.partitionBy(F.lit(0)).orderBy(full_at, F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
             ) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # With this source and all later ones below their caps the level would be `level`; the first that fits is the answer.
    fits = weighted.withColumn("level", F.when(level <= full_at, level))
    common = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return fits.withColumn("common", common).select(
        "source", "source_size",
        F.when(F.col("common").isNull() | (F.col("common") * F.col("weight") >= F.col("cap")), F.col("cap"))
        .otherwise(F.col("common") * F.col("weight")).alias("target"))


def _offset(seed: str) -> Column:
    """A number in [0, 1) for each source and seed, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("\x00null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _placed(documents: DataFrame, *others: Column) -> DataFrame:
    """doc_id, source, size, the class of sizes and the part in which a document is numbered, and ``others``."""
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), *others)
    return sized.withColumn("class", F.floor(F.sqrt(F.col("size").cast("double")))) \
        .withColumn("part", F.pmod(F.coalesce("doc_id", F.lit(-1)), F.lit(PARTS)))


_GROUP = ["source", "class", "part"]


def _starts(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """For each source, class and part: the documents before it along the source, and the source's size and target."""
    along = Window.partitionBy("source").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = sizes.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(*_GROUP, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before")).alias("s")
    target = source_targets(sizes, share, most, weights).alias("t")
    return starts.join(target, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "t.source_size", "t.target")


def _with_copies(placed: DataFrame, starts: DataFrame, seed: str) -> DataFrame:
    """``placed`` with source_size, target and copies."""
    within = Window.partitionBy(*_GROUP).orderBy("size", "doc_id")
    ranked = placed.withColumn("at", F.row_number().over(within)).alias("d")
    start = starts.withColumnRenamed("source", "source_").alias("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("before") + F.col("at")).cast("double")
    copies = F.floor(rate * rank + _offset(seed)) - F.floor(rate * (rank - 1) + _offset(seed))
    return ranked.join(start, F.col("d.source").eqNullSafe(F.col("source_")) & (F.col("d.class") == F.col("s.class"))
                       & (F.col("d.part") == F.col("s.part"))).select("d.*", "source_size", "target", copies.cast("long").alias("copies"))


def mix_copies(documents: DataFrame, seed: str = "mix", share: float = SHARE, most: float = MOST,
               weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies."""
    sizes = materialized(_placed(documents), "sizes")
    return _with_copies(sizes, _starts(sizes, share, most, weights), seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies")


def mix_documents(documents: DataFrame, seed: str = "mix", share: float = SHARE, most: float = MOST,
                  weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``documents``, with all their columns, as often as the mix takes them."""
    starts = _starts(materialized(_placed(documents), "sizes"), share, most, weights)
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document")
    mixed = _with_copies(_placed(documents, whole), starts, seed)
    return mixed.where(F.col("copies") > 0).select(F.explode(F.sequence(F.lit(1).cast("long"), "copies")), "document").select("document.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
      source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT level AS common FROM l WHERE level <= cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT w.source, w.source_size, least(coalesce((SELECT common FROM c) * weight, cap), cap)::DOUBLE AS target,
      ('0x' || substr(md5('mix' || coalesce(w.source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(size::DOUBLE)), doc_id % 32, size, doc_id)::DOUBLE AS k FROM d)
SELECT r.doc_id, r.size, t.source_size, t.target,
       (floor(target / source_size * k + u) - floor(target / source_size * (k - 1) + u))::BIGINT * r.size AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""
