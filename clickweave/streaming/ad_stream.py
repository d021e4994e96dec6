"""The ad-click stream with its blacklist feedback, and the upsert of running statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.storagelevel import StorageLevel

from clickweave import schemas
from clickweave.operators import ads
from clickweave.plans.shared import shared_folder
from clickweave.plans.skew import HotKeys, find_hot_keys
from clickweave.sources.ad_lines import ad_parse, ad_rejects
from clickweave.streaming.report import report_table
from clickweave.streaming.tables import DEFAULT_BUCKETS, GroupTable, KeySet, StreamTable

BATCH_INTERVAL = "5 seconds"
#: A click this far behind the newest one of its batch is reported as late; it counts all the same.
LATE_AFTER = "1 hour"

Publish = Callable[[str, DataFrame], None]


@dataclass(frozen=True)
class AdTables:
    """The tables of one ad stream."""

    user_counts: StreamTable
    blacklist: KeySet
    city_counts: StreamTable
    province_top: GroupTable
    trend: StreamTable
    report: StreamTable
    rejects: str

    @classmethod
    def under(cls, root: str, buckets: int = DEFAULT_BUCKETS) -> AdTables:
        """``buckets``: into how many pieces the keys of a date are dealt; a batch reads and writes those that it touches."""

        def table(name, schema, keys, bucket_by=()):
            return StreamTable(f"{root}/{name}", schema, "added", keys, "date", buckets, bucket_by)

        return cls(
            user_counts=table("ad_user_click_count", schemas.AD_USER_CLICK_COUNT, ("date", "userid", "adid")),
            blacklist=KeySet(f"{root}/ad_blacklist", "userid"),
            city_counts=table("ad_stat", schemas.AD_STAT, ("date", "province", "city", "adid"), ("date", "province")),
            province_top=GroupTable(f"{root}/ad_province_top3", schemas.AD_PROVINCE_TOP3, ("date", "province")),
            trend=table("ad_click_trend", schemas.AD_CLICK_TREND, ("date", "hour", "minute", "adid")),
            report=report_table(f"{root}/report"),
            rejects=f"{root}/rejects",
        )

    def keys(self) -> Iterator[tuple[str, tuple[str, ...]]]:
        """The published tables and what their rows are told apart by (for leaders: the group that is replaced)."""
        for table in (self.user_counts, self.city_counts, self.province_top, self.trend):
            yield _name(table.path), table.keys
        yield _name(self.blacklist.path), (self.blacklist.key,)


def _name(path: str) -> str:
    return path.rstrip("/").split("/")[-1]


def process_batch(lines: DataFrame, batch_id: int, tables: AdTables,
                  threshold: int = ads.DEFAULT_THRESHOLD, k: int = 3, probe_skew: bool = True,
                  publish: Publish | None = None, late_after: str = LATE_AFTER) -> None:
    """One micro-batch of lines.

    Clicks of users blacklisted by an earlier batch are dropped. The rest is added to the counts; a
    user whose count of the day on one ad reaches ``threshold`` is blacklisted for the following
    batches. Province leaders are recomputed for the (date, province) groups the batch touches.

    Only aggregates are written, and of earlier ones only the buckets of the batch's keys are read; a click with a bad
    clock costs its own date and no other. The lines are cached so that the source is read once. Only clicks of users that the
    blacklist's bitmap does not rule out are looked up in it; a user with very many of these is found and spread over tasks
    (``probe_skew``). The first write also fills the cache of
    accepted clicks; the steps after it are independent jobs that run side by side, in the job group of the query.

    ``publish(name, rows)`` is called at the end with the changed rows of each table, for example to
    upsert them into a database. The rows hold totals, not increments, so repeating a call is harmless.

    ``tables.report`` adds up lines and clicks over the life of the query by kind: ``read``, ``rejected`` (unreadable), ``blacklisted``, ``accepted``,
    and of these ``late`` (``late_after`` or more behind the newest click of their batch; they count like any other).
    """
    spark = lines.sparkSession
    lines = lines.persist(StorageLevel.MEMORY_AND_DISK)
    clicks = ad_parse(lines)

    def without_listed(suspects: DataFrame, listed: DataFrame) -> DataFrame:
        hot = find_hot_keys(suspects, "userid") if probe_skew else HotKeys("userid")
        return ads.without_blacklisted(suspects, listed, hot)

    accepted = tables.blacklist.without(clicks, batch_id, without_listed).persist(StorageLevel.MEMORY_AND_DISK)
    touched: dict[str, list] = {}
    changed: dict[str, DataFrame] = {}

    def save(table: StreamTable, rows: DataFrame) -> None:
        touched[table.path] = table.write(rows, batch_id)
        changed[_name(table.path)] = table.changed(spark, batch_id, touched[table.path])

    def save_rejects() -> None:
        ad_rejects(lines).write.mode("overwrite").text(f"{tables.rejects}/batch_id={batch_id}")

    def save_trend() -> None:
        save(tables.trend, ads.minute_trend(accepted))

    def save_blacklist() -> None:
        changed[_name(tables.blacklist.path)] = tables.blacklist.add(
            ads.blacklist(changed[_name(tables.user_counts.path)], threshold), batch_id)

    def save_places() -> None:
        save(tables.city_counts, ads.city_daily(accepted))
        groups = changed[_name(tables.city_counts.path)].select("date", "province").distinct()
        # A province of a date stands in one bucket, which the batch has touched.
        current = tables.city_counts.read_places(spark, batch_id + 1, touched[tables.city_counts.path]).join(
            groups, ["date", "province"], "left_semi")
        leaders = ads.province_top(ads.province_daily(current), k).persist()
        tables.province_top.write(leaders)
        changed[_name(tables.province_top.path)] = leaders

    def save_report() -> None:
        tables.report.write(batch_report(lines, clicks, accepted, late_after), batch_id)

    try:
        save(tables.user_counts, ads.user_daily(accepted))
        steps = [save_rejects, save_report]
        if touched[tables.user_counts.path]:
            steps += [save_blacklist, save_places, save_trend]
        with ThreadPoolExecutor(len(steps)) as pool:
            for done in [pool.submit(inheritable_thread_target(step)) for step in steps]:
                done.result()
        if publish:
            for name, _ in tables.keys():
                if name in changed:
                    publish(name, changed[name])
    finally:
        for cached in (accepted, lines, changed.get(_name(tables.province_top.path))):
            if cached is not None:
                cached.unpersist()


def batch_report(lines: DataFrame, clicks: DataFrame, accepted: DataFrame, late_after: str = LATE_AFTER) -> DataFrame:
    """Rows (kind, n) of one batch, whose inputs are cached; an empty batch has none."""
    read, session = lines.count(), lines.sparkSession
    if not read:
        return session.createDataFrame([], schemas.STREAM_REPORT)
    parsed = clicks.agg(F.count("*").alias("n"), F.max("ts").alias("newest")).first()
    late = F.col("ts") < F.lit(parsed.newest).cast("timestamp") - F.expr(f"interval {late_after}")
    kept = accepted.agg(F.count("*").alias("n"), F.count_if(late).alias("late")).first()
    counts = {"read": read, "rejected": read - parsed.n, "blacklisted": parsed.n - kept.n, "accepted": kept.n, "late": kept.late}
    return session.createDataFrame(list(counts.items()), schemas.STREAM_REPORT)


def _start(writer: DataStreamWriter, available_now: bool, interval: str) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def start_ad_stream(lines: DataFrame, tables: AdTables, checkpoint: str | None = None,
                    threshold: int = ads.DEFAULT_THRESHOLD, available_now: bool = False,
                    interval: str = BATCH_INTERVAL, probe_skew: bool = True,
                    publish: Publish | None = None) -> StreamingQuery:
    """Runs ``process_batch`` on a stream of lines; the checkpoint restores offsets after a restart."""
    writer = lines.writeStream.foreachBatch(
        lambda batch, batch_id: process_batch(batch, batch_id, tables, threshold, probe_skew=probe_skew,
                                               publish=publish)
    ).option("checkpointLocation", shared_folder(lines.sparkSession, checkpoint, "ad_stream"))
    return _start(writer, available_now, interval)


# ---- running statistics, kept in the state store ----------------------------------------------

def upsert_stream(rows: DataFrame, table: StreamTable, checkpoint: str | None = None,
                  available_now: bool = False, interval: str = BATCH_INTERVAL) -> StreamingQuery:
    """Keeps the newest row per key of an update-mode stream in ``table`` (a ``latest`` table)."""
    writer = rows.writeStream.outputMode("update").foreachBatch(table.write).option(
        "checkpointLocation", shared_folder(rows.sparkSession, checkpoint, table.path.rstrip("/").split("/")[-1]))
    return _start(writer, available_now, interval)
