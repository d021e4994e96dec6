"""Keys that hold far more rows than one task should see, and joins that spread them.

Aggregations need none of this: partial aggregation already collapses a heavy key before the shuffle.
Joins of raw rows and ordered windows do. AQE splits a skewed join only when both inputs come
straight from a shuffle; when one side is an aggregate that already has the right partitioning it
does not, so the operators here spread heavy keys explicitly.

The probe is exact and bounded: first rows per hash bucket (at most ``BUCKETS`` small rows per task
are shuffled, whatever the number of keys), then rows per key inside the few heavy buckets. It
decides the layout only; no row is dropped or capped by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
HOT_ROWS_SETTING = "clickweave.hotRows"   # a key below this many rows is never heavy
DEFAULT_HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class HotKeys:
    """Heavy values of one key column, grouped by fan-out (a power of two); null is a value too."""

    key: str
    by_fanout: tuple[tuple[int, tuple], ...] = ()
    null_fanout: int = 1

    def __bool__(self) -> bool:
        return bool(self.by_fanout) or self.null_fanout > 1

    def is_hot(self) -> Column:
        return self.fanout() > 1

    def fanout(self) -> Column:
        """Number of pieces the rows of this key are split into (1 for ordinary keys)."""
        pieces = F.lit(1)
        for size, group in self.by_fanout:
            pieces = F.when(F.col(self.key).isin(list(group)), F.lit(size)).otherwise(pieces)
        if self.null_fanout > 1:
            pieces = F.when(F.col(self.key).isNull(), F.lit(self.null_fanout)).otherwise(pieces)
        return pieces

    def salt(self, *spread: str) -> Column:
        """Piece of a row; ``spread`` are columns that differ between rows of one key."""
        return F.pmod(F.xxhash64(*spread), self.fanout()).cast("int")

    def all_salts(self) -> Column:
        """Every piece of a key, for the side that is replicated."""
        return F.explode(F.sequence(F.lit(0), (self.fanout() - 1).cast("int")))


def find_hot_keys(df: DataFrame, key: str, min_rows: int | None = None) -> HotKeys:
    """Heavy values of ``key``: more rows than an average shuffle partition and than ``min_rows``.

    At most ``spark.sql.shuffle.partitions`` keys can exceed an average partition, which bounds what
    reaches the driver.
    """
    spark = df.sparkSession
    if min_rows is None:
        min_rows = int(spark.conf.get(HOT_ROWS_SETTING, str(DEFAULT_HOT_ROWS)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    keys = df.select(key)
    sizes = keys.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    heavy = F.when(F.col("n") >= min_rows, F.struct("bucket", "n"))
    row = sizes.agg(F.sum("n").alias("total"), F.collect_list(heavy).alias("heavy")).first()
    if not row["heavy"]:
        return HotKeys(key)

    threshold = max(min_rows, row["total"] // partitions)
    buckets = [b["bucket"] for b in row["heavy"] if b["n"] >= threshold]
    if not buckets:
        return HotKeys(key)
    found = (
        keys.where(bucket.isin(buckets)).groupBy(key).agg(F.count("*").alias("n"))
        .where(F.col("n") >= threshold).collect()
    )
    groups: dict[int, list] = {}
    null_fanout = 1
    for r in found:
        pieces = 1 << max(1, (r["n"] // threshold).bit_length())
        if r[key] is None:
            null_fanout = pieces
        else:
            groups.setdefault(pieces, []).append(r[key])
    by_fanout = tuple((size, tuple(sorted(values))) for size, values in sorted(groups.items()))
    return HotKeys(key, by_fanout, null_fanout)


def spread_join(left: DataFrame, right: DataFrame, hot: HotKeys, how: str, spread: list[str]) -> DataFrame:
    """``left`` joined to ``right`` on ``hot.key`` with heavy keys of ``left`` split into pieces.

    ``right`` rows of a heavy key are repeated once per piece, so each left row still meets every
    matching right row exactly once. Valid for inner, left, left_semi and left_anti.
    """
    if not hot:
        return left.join(right, hot.key, how)
    salted = left.withColumn("_piece", hot.salt(*spread))
    repeated = right.withColumn("_piece", hot.all_salts())
    return salted.join(repeated, [hot.key, "_piece"], how).drop("_piece")
