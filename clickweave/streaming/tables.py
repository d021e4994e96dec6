"""Result tables that a stream updates by key.

``StreamTable`` holds one row per key and merges the rows of a micro-batch into it:

* ``added``      counts of one key are summed (adding upsert),
* ``latest``     the row of the newest batch wins (overwriting upsert).

It is plain Parquet. Below a folder per value of its partition column (the date) there is one for each bucket of keys, dealt by a hash, and
below that one per state: ``date=2024-01-01/bucket=7/state=17`` is the whole bucket as batch 17 left it. A micro-batch reads the newest
earlier state of the buckets that its keys fall into and writes their new one; other buckets are neither read nor listed, and a batch
without rows does nothing. So a batch of few keys costs few buckets, however many keys the day has. Two states of a bucket are kept: a
batch that is run again reads what it read the first time and replaces what it wrote; older states are removed, so files do not pile up.

``GroupTable`` replaces all rows of a group: dynamic partition overwrite on the group's columns, nothing old is read.

``KeySet`` keeps keys once: new ones are appended in a folder per batch, a batch without new keys writes nothing. A bitmap of fixed size
over hashed keys stands next to them as a prefilter; the exact look-up sees only rows whose bit is set.

A table belongs to the checkpoint of one query: batch numbers must not start again on an old table, and its number of buckets stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version"      # the last batch that changed a row
BUCKET, STATE = "bucket", "state"
WHOLE = "part"           # partition column of a table that has none of its own
KEPT_STATES = 2
DEFAULT_BUCKETS = 16
#: A bitmap has this many bits: 256 pieces of 4 KB, so it is 1 MB however many keys there are.
BITMAP_BITS = 1 << 23
#: Folders of added keys from which on earlier ones are put together.
MOST_FOLDERS = 32

Place = tuple[str, int]  # a partition value and a bucket
AntiJoin = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class StreamTable:
    path: str
    schema: str                       # DDL of the table's columns
    merge: str                        # added | latest
    keys: tuple[str, ...]
    partition: str | None = None      # column by which the table is split, e.g. the date
    buckets: int = DEFAULT_BUCKETS
    bucket_by: tuple[str, ...] = ()   # keys that decide the bucket, if not all of them: rows equal in these stand together

    def __post_init__(self) -> None:
        if self.merge not in ("added", "latest"):
            raise ValueError(f"unknown merge rule {self.merge!r}")

    # ---- writing ----

    def write(self, rows: DataFrame, batch_id: int) -> list[Place]:
        """Merges the rows of one micro-batch, which hold each key at most once; the places touched are returned."""
        spark = rows.sparkSession
        bucket = F.pmod(F.xxhash64(*(self.bucket_by or self.keys)), F.lit(self.buckets)).cast("int")
        rows = self._split(rows.withColumns({VERSION: F.lit(batch_id).cast("bigint"), BUCKET: bucket})).persist()
        try:
            touched = sorted((r[0], r[1]) for r in rows.select(self._column, BUCKET).distinct().collect())
            if touched:
                merged = self._merged(self._load(spark, batch_id, touched, with_bucket=True).unionByName(rows))
                merged.withColumn(STATE, F.lit(batch_id)).repartition(self._column, BUCKET).write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic").partitionBy(self._column, BUCKET, STATE).parquet(self.path)
        finally:
            rows.unpersist()
        for place in touched:
            earlier = [state for state in self._states(spark, place) if state <= batch_id]
            for state in earlier[:-KEPT_STATES]:
                _remove(spark, f"{self._folder(place)}/{STATE}={state}")
        return touched

    # ---- reading ----

    def read(self, spark: SparkSession, before: int, partitions: Iterable[str] | None = None) -> DataFrame:
        """The table as it was before batch ``before``, or only some of its partitions."""
        return self.read_places(spark, before, self._places(spark, partitions))

    def read_places(self, spark: SparkSession, before: int, places: Iterable[Place]) -> DataFrame:
        """The rows of some places, as they were before batch ``before``."""
        return self._whole(self._load(spark, before, places)).drop(VERSION)

    def changed(self, spark: SparkSession, batch_id: int, touched: Iterable[Place]) -> DataFrame:
        """Current rows of every key that a batch has written; ``touched`` is what its ``write`` returned."""
        return self._whole(self._load(spark, batch_id + 1, touched).where(F.col(VERSION) == batch_id)).drop(VERSION)

    @property
    def _column(self) -> str:
        return self.partition or WHOLE

    def _split(self, rows: DataFrame) -> DataFrame:
        return rows if self.partition else rows.withColumn(WHOLE, F.lit("all"))

    def _whole(self, rows: DataFrame) -> DataFrame:
        return rows if self.partition else rows.drop(WHOLE)

    def _folder(self, place: Place) -> str:
        return f"{self.path}/{self._column}={place[0]}/{BUCKET}={place[1]}"

    def _places(self, spark: SparkSession, partitions: Iterable[str] | None) -> list[Place]:
        values = _children(spark, self.path, self._column) if partitions is None else set(partitions)
        return [(value, int(b)) for value in sorted(values) for b in _children(spark, f"{self.path}/{self._column}={value}", BUCKET)]

    def _states(self, spark: SparkSession, place: Place) -> list[int]:
        return sorted(map(int, _children(spark, self._folder(place), STATE)))

    def _load(self, spark: SparkSession, before: int, places: Iterable[Place], with_bucket: bool = False) -> DataFrame:
        schema = f"{self.schema}, {VERSION} bigint, {BUCKET} int" + ("" if self.partition else f", {WHOLE} string")
        paths = []
        for place in places:
            states = [state for state in self._states(spark, place) if state < before]
            if states:
                paths.append(f"{self._folder(place)}/{STATE}={states[-1]}")
        loaded = (spark.read.schema(schema).option("basePath", self.path).parquet(*paths).drop(STATE) if paths
                  else spark.createDataFrame([], schema))
        return loaded if with_bucket else loaded.drop(BUCKET)

    def _merged(self, rows: DataFrame) -> DataFrame:
        keys = [*self.keys, BUCKET] if self.partition else [*self.keys, BUCKET, WHOLE]
        names = [c for c in rows.columns if c not in (*keys, VERSION)]
        newest = F.max(VERSION).alias(VERSION)
        if self.merge == "added":
            return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names], newest)
        return rows.groupBy(*keys).agg(*[F.max_by(c, VERSION).alias(c) for c in names], newest)


@dataclass(frozen=True)
class GroupTable:
    """Rows by group; a batch replaces the groups it has.

    The folders are named after the group, the files hold all columns. A group's text is kept behind a sign, as a folder
    for an empty text would be one for null.
    """

    path: str
    schema: str
    keys: tuple[str, ...]             # the columns of a group

    def write(self, rows: DataFrame) -> None:
        folders = {f"of_{key}": F.concat(F.lit("="), F.coalesce(F.col(key).cast("string"), F.lit(""))) for key in self.keys}
        rows.withColumns(folders).repartition(*folders).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        if not _exists(spark, self.path):
            return spark.createDataFrame([], self.schema)
        folders = ", ".join(f"of_{key} string" for key in self.keys)
        return spark.read.schema(f"{self.schema}, {folders}").parquet(self.path).drop(*[f"of_{key}" for key in self.keys])


@dataclass(frozen=True)
class KeySet:
    """Keys (one bigint column), each once."""

    path: str
    key: str

    @property
    def schema(self) -> str:
        return f"{self.key} bigint"

    def add(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Keeps the keys of ``rows`` that no earlier batch has added; these are returned.

        A batch that is run again finds the same keys new and replaces its own folder.
        """
        spark = rows.sparkSession
        new = self.without(rows.select(self.key).distinct(), batch_id).persist()
        try:
            if not new.isEmpty():
                new.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/keys/batch={batch_id}")
                bits = self._bits(new).unionByName(self.bitmap(spark, batch_id)).groupBy("piece").agg(F.bitmap_or_agg("bits").alias("bits"))
                bits.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bitmap/batch={batch_id}")
                self._tidy(spark, batch_id)
        finally:
            new.unpersist()
        return self._keys(spark, [batch_id] if batch_id in self._batches(spark, "keys") else [])

    def read(self, spark: SparkSession, before: int) -> DataFrame:
        """Keys that batches before ``before`` have added."""
        return self._keys(spark, [b for b in self._batches(spark, "keys") if b < before], self._together(spark))

    def bitmap(self, spark: SparkSession, before: int) -> DataFrame:
        """piece and bits of the hashed keys before batch ``before``; at most ``BITMAP_BITS / 32768`` rows of 4 KB."""
        known = [b for b in self._batches(spark, "bitmap") if b < before]
        schema = "piece bigint, bits binary"
        return spark.read.schema(schema).parquet(f"{self.path}/bitmap/batch={known[-1]}") if known else spark.createDataFrame([], schema)

    def suspects(self, rows: DataFrame, before: int) -> DataFrame:
        """``rows`` with a column ``suspect``: whether the key's bit is set. Where it is not, no batch before ``before`` has added the key."""
        bits = F.broadcast(self.bitmap(rows.sparkSession, before))  # 1 MB at most
        place = f"cast(bitmap_bit_position({self._at}) as int)"
        byte = f"cast(conv(hex(substring(bits, {place} div 8 + 1, 1)), 16, 10) as int)"
        joined = rows.withColumn("piece", F.expr(f"bitmap_bucket_number({self._at})")).join(bits, "piece", "left")
        suspect = F.coalesce(F.expr(f"({byte} & shiftleft(1, {place} % 8)) != 0"), F.lit(False))
        return joined.withColumn("suspect", suspect).select(*rows.columns, "suspect")

    def without(self, rows: DataFrame, before: int, anti_join: AntiJoin | None = None) -> DataFrame:
        """Rows whose key no batch before ``before`` has added: those whose bit is clear, and of the others what an exact look-up lets through."""
        marked = self.suspects(rows, before)
        clear = marked.where(~F.col("suspect")).drop("suspect")
        looked_up = marked.where("suspect").drop("suspect")
        known = self.read(rows.sparkSession, before)
        return clear.unionByName(anti_join(looked_up, known) if anti_join else looked_up.join(known, self.key, "left_anti"))

    @property
    def _at(self) -> str:
        """SQL for the place of a key in the bitmap, from 1."""
        return f"(pmod(xxhash64({self.key}), {BITMAP_BITS}) + 1)"

    def _bits(self, keys: DataFrame) -> DataFrame:
        return keys.groupBy(F.expr(f"bitmap_bucket_number({self._at})").alias("piece")).agg(
            F.expr(f"bitmap_construct_agg(bitmap_bit_position({self._at}))").alias("bits"))

    def _batches(self, spark: SparkSession, what: str) -> list[int]:
        return sorted(map(int, _children(spark, f"{self.path}/{what}", "batch")))

    def _together(self, spark: SparkSession) -> list[int]:
        """Last batches of folders that hold the keys of all batches so far, complete ones only."""
        found = sorted(map(int, _children(spark, f"{self.path}/keys", "upto")))
        return [b for b in found if _exists(spark, f"{self.path}/keys/upto={b}/_SUCCESS")]

    def _keys(self, spark: SparkSession, batches: list[int], together: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/keys/upto={b}" for b in together or []] + [f"{self.path}/keys/batch={b}" for b in batches]
        found = spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)
        return found.distinct() if len(paths) > 1 else found

    def _tidy(self, spark: SparkSession, batch_id: int) -> None:
        """Puts the folders of earlier batches together in one, and removes old bitmaps.

        A reader takes what is there; keys that stand in two folders, also after a failure in between, are one key to it.
        """
        for old in [b for b in self._batches(spark, "bitmap") if b <= batch_id][:-KEPT_STATES]:
            _remove(spark, f"{self.path}/bitmap/batch={old}")
        earlier = [b for b in self._batches(spark, "keys") if b < batch_id]
        if len(earlier) >= MOST_FOLDERS:
            old = self._together(spark)
            self._keys(spark, earlier, old).repartition(self.key).write.mode("overwrite").parquet(f"{self.path}/keys/upto={earlier[-1]}")
            for batch in earlier:
                _remove(spark, f"{self.path}/keys/batch={batch}")
            for batch in old:
                _remove(spark, f"{self.path}/keys/upto={batch}")


def _hadoop(spark: SparkSession, path: str):
    """A path and the file system it is on."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    found, files = _hadoop(spark, path)
    return files.exists(found)


def _remove(spark: SparkSession, path: str) -> None:
    found, files = _hadoop(spark, path)
    files.delete(found, True)


def _children(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the partition folders ``column=value`` directly below a path."""
    found, files = _hadoop(spark, path)
    if not files.exists(found):
        return []
    names = [status.getPath().getName() for status in files.listStatus(found)]
    return [name.split("=", 1)[1] for name in names if name.startswith(f"{column}=")]
