"""Runs one job: ``python -m clickweave <job> …`` (or the same arguments after spark-submit)."""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clickweave import sinks
from clickweave.operators.ads import DEFAULT_THRESHOLD
from clickweave.params import TaskParams
from clickweave.plans import jobs
from clickweave.plans.shared import remove_shared
from clickweave.session import build_session
from clickweave.sources import ad_lines, warehouse
from clickweave import schemas
from clickweave.streaming import ad_stream, report, state
from clickweave.streaming.ad_stream import BATCH_INTERVAL, AdTables, start_ad_stream
from clickweave.streaming.tables import StreamTable
from clickweave.streaming.words import running_word_count

BATCH_JOBS = ("session-reports", "session-stat", "session-sample", "session-detail", "top-categories", "top-sessions",
              "page-flow", "area-products")
STATISTICS = ("city-daily-stream", "minute-trend-stream", "rolling-hour-stream")


def _table(spark: SparkSession, name: str) -> DataFrame:
    """A Parquet directory when the name holds a slash, else a catalogue table."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def batch_reports(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """Reports of a job by the name of their folder below the output ("" for the output itself)."""
    if args.job != "session-reports":
        return {"": batch_report(spark, args)}
    actions = warehouse.load_actions(_table(spark, args.actions))
    return jobs.session_reports(
        actions, warehouse.load_users(_table(spark, args.users)), TaskParams.from_json(args.params),
        args.task_id, args.total, args.seed, args.shared_folder)


def batch_report(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    params = TaskParams.from_json(args.params)
    task_id = args.task_id
    actions = warehouse.load_actions(_table(spark, args.actions))

    def users():
        return warehouse.load_users(_table(spark, args.users))

    match args.job:
        case "session-stat":
            return jobs.session_aggr_stat(actions, users(), params, task_id)
        case "session-sample":
            return jobs.session_random_extract(actions, users(), params, task_id, args.total, args.seed)
        case "session-detail":
            return jobs.session_detail(actions, users(), params, task_id, args.total, args.seed)
        case "top-categories":
            return jobs.top10_category(actions, params, task_id)
        case "top-sessions":
            return jobs.top10_session(actions, users(), params, task_id)
        case "page-flow":
            return jobs.page_split_convert_rate(actions, params, task_id)
        case "area-products":
            products = warehouse.load_products(_table(spark, args.products))
            cities = _table(spark, args.cities) if args.cities else warehouse.city_area_dim(spark)
            return jobs.area_top3_product(actions, cities, products, params, task_id)
    raise ValueError(args.job)


def _write(name: str, report: DataFrame, args: argparse.Namespace) -> None:
    if args.output:
        sinks.append_parquet(report, f"{args.output}/{name}".rstrip("/"))
    elif args.jdbc_url:
        table = "_".join(part for part in (args.jdbc_table, name) if part)
        sinks.append_jdbc(report, args.jdbc_url, table, dict(p.split("=", 1) for p in args.jdbc_option))
    else:
        report.show(truncate=False)


def _lines(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.kafka_brokers:
        return ad_lines.kafka_lines(spark, args.kafka_brokers, args.kafka_topic)
    if args.socket:
        host, port = args.socket.rsplit(":", 1)
        return ad_lines.socket_lines(spark, host, int(port))
    return ad_lines.file_lines(spark, args.files)


def _statistic(spark: SparkSession, lines: DataFrame, args: argparse.Namespace) -> StreamingQuery:
    """A running statistic kept in the state store, written below the output, with a report of its life next to it."""
    clicks = ad_lines.ad_parse(lines, report.OBSERVED)
    if args.job == "city-daily-stream":
        rows, table = state.city_daily_counts(clicks), (schemas.AD_STAT, ("date", "province", "city", "adid"), "date")
    elif args.job == "minute-trend-stream":
        rows, table = state.minute_trend_counts(clicks), (schemas.AD_CLICK_TREND, ("date", "hour", "minute", "adid"), "date")
    else:
        if args.available_now:  # else timers that are not yet due would keep the query open
            spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        rows, table = state.rolling_counts(clicks), (schemas.AD_ROLLING_HOUR, ("adid",), None)
    schema, keys, partition = table
    listener = report.LifeReport(spark, f"{args.output}_report")
    spark.streams.addListener(listener)
    try:
        query = ad_stream.upsert_stream(rows, StreamTable(args.output, schema, "latest", keys, partition), args.checkpoint,
                                        args.available_now, args.interval)
        query.awaitTermination()
        listener.wait_for(query)
    finally:
        spark.streams.removeListener(listener)
    return query


def _stream(spark: SparkSession, args: argparse.Namespace) -> None:
    lines = _lines(spark, args)
    if args.job in STATISTICS:
        _statistic(spark, lines, args)
        return
    if args.job == "ad-stream":
        query = start_ad_stream(lines, AdTables.under(args.output), args.checkpoint, args.threshold,
                                args.available_now, args.interval, args.probe_skew)
    else:
        trigger = {"availableNow": True} if args.available_now else {"processingTime": args.interval}
        query = running_word_count(lines).writeStream.outputMode("complete").format("console").option(
            "checkpointLocation", args.checkpoint).trigger(**trigger).start()
    query.awaitTermination()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clickweave")
    sub = p.add_subparsers(dest="job", required=True)
    for job in BATCH_JOBS:
        b = sub.add_parser(job)
        b.add_argument("--actions", default="user_visit_action", help="table name or Parquet directory")
        b.add_argument("--users", default="user_info")
        b.add_argument("--products", default="product_info")
        b.add_argument("--cities", help="table for the city dimension; built-in rows when left out")
        b.add_argument("--params", required=True, help="task parameters as JSON")
        b.add_argument("--task-id", help="identifies the run in the report; random when left out")
        b.add_argument("--total", type=int, default=100, help="sessions to sample")
        b.add_argument("--seed", default="42")
        b.add_argument("--output", help="Parquet directory to append to; printed when no sink is given")
        b.add_argument("--shared-folder", help="where session-reports keeps the filtered sessions")
        b.add_argument("--jdbc-url")
        b.add_argument("--jdbc-table")
        b.add_argument("--jdbc-option", action="append", default=[], metavar="KEY=VALUE")
    for job in ("ad-stream", *STATISTICS, "word-stream"):
        s = sub.add_parser(job)
        source = s.add_mutually_exclusive_group(required=True)
        source.add_argument("--kafka-brokers")
        source.add_argument("--socket", metavar="HOST:PORT")
        source.add_argument("--files", help="directory of text files")
        s.add_argument("--kafka-topic")
        s.add_argument("--checkpoint", required=True)
        s.add_argument("--output", required=job != "word-stream", help="root directory of the result tables")
        s.add_argument("--probe-skew", action=argparse.BooleanOptionalAction, default=True,
                       help="find users with very many clicks in each batch and spread them")
        s.add_argument("--threshold", type=int, default=DEFAULT_THRESHOLD)
        s.add_argument("--interval", default="1 second" if job == "word-stream" else BATCH_INTERVAL)
        s.add_argument("--available-now", action="store_true", help="process what is there and stop")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or build_session(f"clickweave-{args.job}")
    if args.job in BATCH_JOBS:
        args.task_id = args.task_id or str(uuid.uuid4())
        try:
            for name, report in batch_reports(spark, args).items():
                _write(name, report, args)
        finally:
            if args.job == "session-reports":
                remove_shared(spark, jobs.kept_name(args.task_id), args.shared_folder)
    else:
        _stream(spark, args)


if __name__ == "__main__":
    main()
