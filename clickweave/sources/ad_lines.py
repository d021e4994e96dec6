"""Ad-click lines: streaming sources and the parser.

A line is ``timestamp_ms province city userid adid`` with one space between the fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_lines(spark: SparkSession, brokers: str, topic: str, **options: str) -> DataFrame:
    """Streaming lines from a Kafka topic; needs Spark's Kafka connector on the class path.

    New queries start at the latest offset; afterwards the checkpoint decides.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
    )
    return reader.options(**options).load().select(F.col("value").cast("string").alias("value"))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Streaming lines from a socket (demonstrations only: the source cannot be replayed)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Streaming lines from text files that appear in a directory."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def _split_line(lines: DataFrame) -> DataFrame:
    part = F.split(F.col("value"), " ")

    def field(i: int) -> Column:
        return F.get(part, i)

    return lines.select(
        "value",
        field(0).try_cast("bigint").alias("timestamp_ms"),
        field(1).alias("province"),
        field(2).alias("city"),
        field(3).try_cast("bigint").alias("userid"),
        field(4).try_cast("bigint").alias("adid"),
    )


def _readable() -> Column:
    fields = ("timestamp_ms", "province", "city", "userid", "adid")
    readable = F.lit(True)
    for name in fields:
        readable = readable & F.col(name).isNotNull()
    return readable


def ad_parse(lines: DataFrame, observed_as: str | None = None) -> DataFrame:
    """Readable lines as columns, with the event time ``ts``.

    ``observed_as`` names metrics that a query then reports with each batch: lines ``read``, and of these ``accepted`` and ``rejected``.
    """
    split = _split_line(lines)
    if observed_as:
        split = split.observe(observed_as, F.count(F.lit(1)).alias("read"), F.count_if(_readable()).alias("accepted"),
                              F.count_if(~_readable()).alias("rejected"))
    return split.where(_readable()).drop("value").withColumn("ts", F.timestamp_millis("timestamp_ms"))


def ad_rejects(lines: DataFrame) -> DataFrame:
    """Lines that cannot be read, unchanged; together with ``ad_parse`` they are all lines."""
    return _split_line(lines).where(~_readable()).select("value")
