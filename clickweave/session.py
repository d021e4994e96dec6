"""SparkSession settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Times in the input are plain wall-clock text, so the session time zone must not shift them.
# AQE coalesces small shuffle partitions and splits skewed join partitions at run time.
BASE_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python call site of every column expression makes building a plan several times slower.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "clickweave", master: str | None = None,
                  settings: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings above; ``settings`` win over them. On a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
