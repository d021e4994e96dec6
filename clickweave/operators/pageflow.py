"""Successive pages of a session and one-step conversion along a page flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickweave.plans.skew import HotKeys, find_hot_keys


def next_pages(actions: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Every action with the page that follows it in its session (null for the last one).

    An ordinary session is one window group. A session with more rows than a task should sort is cut
    into seconds: inside a second the next page comes from the same window; the last action of a
    second takes the first page of the session's next non-empty second, from a second window over one
    row per second. Its size is bounded by the length of the period, not by the actions in it.
    """
    hot = find_hot_keys(actions, "session_id") if hot is None else hot
    rows = actions.select("session_id", "action_ts", "event_id", "page_id")
    in_order = ["action_ts", "event_id"]
    result = ["session_id", "event_id", "page_id", "next_page_id"]
    if not hot:
        order = Window.partitionBy("session_id").orderBy(*in_order)
        return rows.withColumn("next_page_id", F.lead("page_id").over(order)).select(*result)

    rows = rows.withColumn("slice", F.when(hot.is_hot(), F.date_trunc("second", "action_ts")))
    order = Window.partitionBy("session_id", "slice").orderBy(*in_order)
    linked = rows.select(
        "*",
        F.lead("page_id").over(order).alias("next_page_id"),
        F.lead("event_id").over(order).isNull().alias("closes"),
        F.first("page_id").over(order).alias("first_page_id"),
    )
    # Written as a sum so that neither part is pushed below the window: both branches then read the
    # same shuffle instead of scanning the actions twice.
    flags = F.col("closes").cast("int") + hot.is_hot().cast("int")
    slices = Window.partitionBy("session_id").orderBy("slice")
    closing = linked.where(flags == 2).withColumn("next_page_id", F.lead("first_page_id").over(slices))
    return linked.where(flags < 2).select(*result).unionByName(closing.select(*result))


def page_pairs(actions: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Successive page pairs of every session."""
    return next_pages(actions, hot).where(F.col("next_page_id").isNotNull())


def page_flow(next_page_rows: DataFrame, flow: Sequence[int]) -> DataFrame:
    """One row per step of ``flow``: (step, page_split, page_count, rate).

    Step 0 counts the visits of the first page. Step i counts the moves from page i-1 to page i of
    the flow; its rate is that count over the count of the step before, null when that is 0. All
    counts come from one pass with a counter per step, so nothing but those counters is shuffled.
    """
    page, following = F.col("page_id"), F.col("next_page_id")
    if not flow:
        raise ValueError("the target page flow is empty")
    steps = list(zip(flow[:-1], flow[1:]))
    counted = next_page_rows.where(page.isin(sorted(set(flow)))).agg(
        F.count_if(page == flow[0]).alias("n0"),
        *[F.count_if((page == a) & (following == b)).alias(f"n{i}") for i, (a, b) in enumerate(steps, 1)],
    )

    def step_row(i: int, name: str) -> Column:
        rate = F.try_divide(F.col(f"n{i}").cast("double"), F.col(f"n{i - 1}")) if i else F.lit(None).cast("double")
        return F.struct(
            F.lit(i).alias("step"), F.lit(name).alias("page_split"),
            F.col(f"n{i}").alias("page_count"), rate.alias("rate"))

    rows = [step_row(0, str(flow[0]))] + [step_row(i, f"{a}_{b}") for i, (a, b) in enumerate(steps, 1)]
    return counted.select(F.inline(F.array(*rows)))


def page_flow_rates(flow_rows: DataFrame) -> DataFrame:
    """(step, page_split, rate) of the moves."""
    return flow_rows.where(F.col("step") > 0).select("step", "page_split", "rate")


def page_flow_rate_string(flow_rows: DataFrame) -> DataFrame:
    """All rates as one text ``1_2=0.5|2_3=…`` in flow order (one row; a flow has few steps)."""
    moves = flow_rows.where(F.col("step") > 0)
    text = F.concat(F.col("page_split"), F.lit("="), F.coalesce(F.col("rate").cast("string"), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("step", text.alias("text"))))
    return moves.agg(F.array_join(ordered["text"], "|").alias("convertRate"))
