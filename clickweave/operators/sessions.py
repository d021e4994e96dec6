"""Session roll-up, profile, filter, distributions and stratified sample."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickweave.functions.aggregates import count_between, sorted_set
from clickweave.functions.scalars import format_time, seconds_between
from clickweave.params import TaskParams
from clickweave.plans.skew import HotKeys, find_hot_keys, spread_join
from clickweave.schemas import STEP_BUCKETS, VISIT_BUCKETS
from clickweave.sources.warehouse import NO_CLICK

UNRESTRICTED = TaskParams()
SAMPLE_PIECES = 256


def _keyword() -> Column:
    return F.nullif(F.col("search_keyword"), F.lit(""))


def _clicked_category() -> Column:
    return F.nullif(F.col("click_category_id"), F.lit(NO_CLICK).cast("bigint"))


def _hits(params: TaskParams) -> list[Column]:
    """One flag per restricted action attribute: does any action of the session match?

    A flag is a fixed-size aggregate, so filtering never needs the value lists of a session.
    """
    hits = []
    if params.keywords:
        match = F.col("search_keyword").isin(list(params.keywords))
        hits.append(F.coalesce(F.bool_or(match), F.lit(False)).alias("keyword_hit"))
    if params.category_ids:
        match = F.col("click_category_id").isin([c for c in params.category_ids if c != NO_CLICK])
        hits.append(F.coalesce(F.bool_or(match), F.lit(False)).alias("category_hit"))
    return hits


def session_spans(actions: DataFrame, params: TaskParams = UNRESTRICTED) -> DataFrame:
    """One row per session with fixed-size measures only: a single, partially aggregated shuffle."""
    spans = actions.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"),
        F.min("action_ts").alias("start_ts"),
        F.max("action_ts").alias("end_ts"),
        F.count("*").alias("step_length"),
        *_hits(params),
    )
    return spans.withColumn("visit_length", seconds_between(F.col("end_ts"), F.col("start_ts")))


def session_rollup(actions: DataFrame, params: TaskParams = UNRESTRICTED) -> DataFrame:
    """``session_spans`` plus the distinct keywords and clicked categories of each session.

    The first aggregation is by (session, keyword, category): the rows of a very long session are
    spread over the shuffle and collapse to its distinct values before the lists are built.
    """
    hits = _hits(params)
    values = actions.groupBy(
        "session_id", _keyword().alias("keyword"), _clicked_category().alias("category")
    ).agg(
        F.min("user_id").alias("user_id"),
        F.min("action_ts").alias("start_ts"),
        F.max("action_ts").alias("end_ts"),
        F.count("*").alias("n"),
        *hits,
    )
    hit_names = [h for h in ("keyword_hit", "category_hit") if h in values.columns]
    rollup = values.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.sum("n").alias("step_length"),
        *[F.bool_or(h).alias(h) for h in hit_names],
        sorted_set(F.col("keyword")).alias("search_keywords"),
        sorted_set(F.col("category")).alias("click_category_ids"),
    )
    return rollup.withColumn("visit_length", seconds_between(F.col("end_ts"), F.col("start_ts")))


def session_profile(rollup: DataFrame, users: DataFrame) -> DataFrame:
    """Roll-up with the user's attributes; sessions of unknown users drop out.

    Both inputs reach the join straight from a shuffle on ``user_id``, so AQE can split a user with
    very many sessions, or broadcast a user table it has found to be small.
    """
    attributes = users.select("user_id", "age", "professional", "sex", F.col("city").alias("user_city"))
    return rollup.join(attributes, "user_id", "inner")


def session_filter(profile: DataFrame, params: TaskParams) -> DataFrame:
    """Sessions that meet every restricted attribute; ``profile`` must come from the same ``params``."""
    tests = []
    if params.start_age is not None and params.end_age is not None:
        tests.append(F.col("age").between(params.start_age, params.end_age))
    if params.professionals:
        tests.append(F.col("professional").isin(list(params.professionals)))
    if params.cities:
        tests.append(F.col("user_city").isin(list(params.cities)))
    if params.sex:
        tests.append(F.col("sex") == params.sex)
    if params.keywords:
        tests.append(F.col("keyword_hit"))
    if params.category_ids:
        tests.append(F.col("category_hit"))
    return profile.where(reduce(and_, tests)) if tests else profile


def kept_sessions(actions: DataFrame, users: DataFrame, params: TaskParams) -> DataFrame:
    """The filtered sessions without value lists: input of the jobs that only count or select."""
    return session_filter(session_profile(session_spans(actions, params), users), params)


def filtered_actions(actions: DataFrame, kept: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Actions of the kept sessions."""
    hot = find_hot_keys(actions, "session_id") if hot is None else hot
    return spread_join(actions, kept.select("session_id"), hot, "left_semi", ["event_id"])


def session_buckets(kept: DataFrame) -> DataFrame:
    """Number of sessions, and of sessions per visit-length and step-length bucket (one row)."""
    visit = [count_between("visit_length", lo, hi).alias(name) for name, lo, hi in VISIT_BUCKETS]
    step = [count_between("step_length", lo, hi).alias(name) for name, lo, hi in STEP_BUCKETS]
    return kept.agg(F.count("*").alias("session_count"), *visit, *step)


def session_ratios(buckets: DataFrame) -> DataFrame:
    """Bucket counts as shares of all sessions, half-up to two places; 0.0 when there is no session."""
    return buckets.selectExpr("session_count", *[
        f"round({name} / greatest(session_count, 1), 2) AS {name}_ratio"
        for name, _, _ in VISIT_BUCKETS + STEP_BUCKETS])


def _hour() -> Column:
    return F.date_trunc("hour", "start_ts").alias("hour_start")


def _date_and_hour() -> list[Column]:
    return [F.date_format("hour_start", "yyyy-MM-dd").alias("date"), F.date_format("hour_start", "HH").alias("hour")]


def session_hour_counts(kept: DataFrame) -> DataFrame:
    """Sessions per date and hour of their start."""
    counts = kept.groupBy(_hour()).agg(F.count("*").alias("session_count"))
    return counts.select(*_date_and_hour(), "session_count")


def hour_quotas(kept: DataFrame, total: int) -> DataFrame:
    """Sessions to sample from each hour of each date (hour_start, quota), by largest remainder.

    Every hour gets the whole part of its proportional share of ``min(total, sessions)``; what is left over goes
    to the hours with the largest fractions, the earlier hour first on a tie. No quota exceeds its hour.
    """
    # At most 24 rows per date, so a window over all of them stays small.
    everything = Window.partitionBy(F.lit(1))
    shares = kept.groupBy(_hour()).agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(everything)).withColumn(
        "wanted", F.least(F.lit(int(total)).cast("bigint"), "all"))
    parts = shares.select("hour_start", "wanted", F.expr("n * wanted div all").alias("whole"), F.expr("n * wanted % all").alias("rest"))
    turn = F.row_number().over(everything.orderBy(F.desc("rest"), "hour_start"))
    left = F.col("wanted") - F.sum("whole").over(everything)
    quotas = parts.select("hour_start", (F.col("whole") + (turn <= left).cast("bigint")).alias("quota"))
    return quotas.where(F.col("quota") > 0)


def sample_sessions(kept: DataFrame, total: int = 100, seed: str = "42", pieces: int = SAMPLE_PIECES) -> DataFrame:
    """Stratified sample without replacement: (date, hour, session_id, start_ts).

    Exactly ``min(total, sessions)`` rows, see ``hour_quotas``. Within an hour the sessions with the
    smallest ``md5(seed + session_id)`` are taken, so the sample is repeatable. No hour's quota exceeds
    ``total``, hence the first ``total`` sessions of each piece of an hour contain the answer and only
    those meet in the final ranking.

    ``kept`` is used twice, for the counts and for the ranking; both uses share its session shuffle.
    """
    quotas = hour_quotas(kept, total)

    candidates = kept.select(
        _hour(), "session_id", "start_ts",
        F.md5(F.concat(F.lit(seed), F.col("session_id")).cast("binary")).alias("pick"),
        F.pmod(F.xxhash64("session_id"), F.lit(pieces)).cast("int").alias("piece"),
    )
    in_piece = Window.partitionBy("hour_start", "piece").orderBy("pick", "session_id")
    ranked = candidates.withColumn("rank_in_piece", F.row_number().over(in_piece)).where(
        F.col("rank_in_piece") <= total)

    in_hour = Window.partitionBy("hour_start").orderBy("pick", "session_id")
    return (
        ranked.join(quotas, "hour_start")
        .withColumn("rank", F.row_number().over(in_hour))
        .where(F.col("rank") <= F.col("quota"))
        .select(*_date_and_hour(), "session_id", "start_ts")
    )


def sample_with_lists(actions: DataFrame, sample: DataFrame) -> DataFrame:
    """Sampled sessions with their keyword and category lists, built for the sampled sessions only."""
    chosen = sample.select("session_id", "start_ts")
    values = actions.join(chosen, "session_id").groupBy(
        "session_id", "start_ts", _keyword().alias("keyword"), _clicked_category().alias("category")
    ).agg(F.count("*").alias("n"))
    return values.groupBy("session_id", "start_ts").agg(
        sorted_set(F.col("keyword")).alias("search_keywords"),
        sorted_set(F.col("category")).alias("click_category_ids"),
    ).withColumn("start_time", format_time(F.col("start_ts")))


def sample_detail(actions: DataFrame, sample: DataFrame) -> DataFrame:
    """Every action of the sampled sessions."""
    return actions.join(sample.select("session_id"), "session_id", "left_semi")
