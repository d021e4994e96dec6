"""Stream operators that keep their own state per key, outside event-time windows.

* ``running_counts``   a count per key that is kept for ever: no click is too late for it,
* ``rolling_counts``   clicks of the last hour per key by the time they arrive, in a ring of minute slots,
* ``accepted_stream``  the blacklist rule decided click by click.

All of them need the RocksDB state store (``build_session`` sets it) and a checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from clickweave.functions.scalars import format_date
from clickweave.operators.ads import DEFAULT_THRESHOLD

COUNT = "clickCount"
SLOT_MS, SLOTS = 60_000, 60
#: Days before a user's newest one whose counts are kept for a late click.
KEPT_DAYS = 7

Clock = Callable[[object], int]


def _fields(df: DataFrame, names: Sequence[str]) -> list[StructField]:
    return [df.schema[name] for name in names]


def counted(clicks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clicks per key and Arrow batch, before they move: a widespread key is a row for each batch, not for each click."""
    schema = StructType([*_fields(clicks, keys), StructField("n", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(list(keys), dropna=False, sort=False).size().reset_index(name="n")

    return clicks.select(*keys).mapInPandas(run, schema)


class RunningCount(StatefulProcessor):
    """A number per key that only grows."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.total.get()
        total = int(sum(batch["n"].sum() for batch in rows)) + (before[0] if before else 0)
        self.total.update((total,))
        yield pd.DataFrame([(*key, total)], columns=[*self.keys, COUNT])

    def close(self) -> None:
        pass


def running_counts(clicks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clicks per key since the stream began, for update mode: a row for every key that a batch touches.

    There is no watermark, so a click counts however late it comes; the state holds one number per key, for ever.
    """
    schema = StructType([*_fields(clicks, keys), StructField(COUNT, LongType())])
    return counted(clicks, keys).groupBy(*keys).transformWithStateInPandas(
        RunningCount(keys), outputStructType=schema, outputMode="Update", timeMode="None")


def city_daily_counts(clicks: DataFrame) -> DataFrame:
    """Running clicks per (date, province, city, adid)."""
    return running_counts(clicks.withColumn("date", format_date(F.col("ts"))), ("date", "province", "city", "adid"))


def minute_trend_counts(clicks: DataFrame) -> DataFrame:
    """Running clicks per (date, hour, minute, adid), the time as text parts."""
    parts = {"date": "yyyyMMdd", "hour": "HH", "minute": "mm"}
    return running_counts(clicks.withColumns({name: F.date_format("ts", form) for name, form in parts.items()}), (*parts, "adid"))


class Ring:
    """Counts of the last ``slots`` slots and their sum: the newest is added, the oldest is taken off."""

    def __init__(self, slot: int, total: int, counts: Sequence[int]):
        self.slot, self.total, self.counts = slot, total, list(counts)

    @classmethod
    def empty(cls, slot: int, slots: int = SLOTS) -> Ring:
        return cls(slot, 0, [0] * slots)

    def advance(self, slot: int) -> None:
        """Moves on to ``slot``; what falls out of the ring is subtracted. A clock that goes back changes nothing."""
        for passed in range(self.slot + 1, min(slot, self.slot + len(self.counts)) + 1):
            self.total -= self.counts[passed % len(self.counts)]
            self.counts[passed % len(self.counts)] = 0
        self.slot = max(self.slot, slot)

    def add(self, n: int) -> None:
        self.total += n
        self.counts[self.slot % len(self.counts)] += n


def arrival_clock(timer_values) -> int:
    """The time of the batch in milliseconds."""
    return timer_values.getCurrentProcessingTimeInMs()


class RollingCount(StatefulProcessor):
    """The ring of a key. A timer at the end of each slot moves it on and reports, until it is empty."""

    def __init__(self, keys: Sequence[str], slot_ms: int = SLOT_MS, slots: int = SLOTS, clock: Clock = arrival_clock):
        self.keys, self.slot_ms, self.slots, self.clock = list(keys), slot_ms, slots, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "slot bigint, total bigint, counts array<bigint>")

    def _report(self, key, ring: Ring) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(*key, (ring.slot + 1) * self.slot_ms, ring.total)], columns=[*self.keys, "window_end_ms", COUNT])

    def _moved(self, timer_values) -> Ring:
        slot = self.clock(timer_values) // self.slot_ms
        known = self.ring.get()
        ring = Ring(*known) if known else Ring.empty(slot, self.slots)
        ring.advance(slot)
        return ring

    def _keep(self, ring: Ring) -> None:
        self.ring.update((ring.slot, ring.total, ring.counts))
        due = (ring.slot + 1) * self.slot_ms
        for timer in list(self.handle.listTimers()):
            if timer != due:
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring = self._moved(timerValues)
        ring.add(int(sum(batch["n"].sum() for batch in rows)))
        self._keep(ring)
        yield from self._report(key, ring)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ring = self._moved(timerValues)
        if ring.total:
            self._keep(ring)
        else:
            self.ring.clear()
        yield from self._report(key, ring)

    def close(self) -> None:
        pass


def rolling_counts(clicks: DataFrame, keys: Sequence[str] = ("adid",), slot_ms: int = SLOT_MS, slots: int = SLOTS,
                   clock: Clock = arrival_clock) -> DataFrame:
    """Clicks per key that arrived in the last ``slots`` slots, the running one included, for update mode.

    A row per key for each batch that touches it and for each slot that passes until its window is empty: the keys, window_end_ms (end of the
    running slot), clickCount. A key's state is ``slots`` numbers and their sum; an empty one is removed. ``clock`` gives the time of
    a batch; by default when Spark started it.
    """
    schema = StructType([*_fields(clicks, keys), StructField("window_end_ms", LongType()), StructField(COUNT, LongType())])
    return counted(clicks, keys).groupBy(*keys).transformWithStateInPandas(
        RollingCount(keys, slot_ms, slots, clock), outputStructType=schema, outputMode="Update", timeMode="ProcessingTime")


class AcceptedClicks(StatefulProcessor):
    """Counts of a user by (date, ad) until one reaches the threshold; from then on only the time of that click."""

    def __init__(self, columns: Sequence[str], threshold: int, tie: str, kept_days: int):
        self.columns, self.threshold, self.tie, self.kept_days = list(columns), threshold, tie, kept_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "day int, adid bigint", "n bigint")
        self.listed = handle.getValueState("listed", "micros bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clicks = pd.concat(list(rows), ignore_index=True).sort_values(["click_micros", self.tie], kind="stable")
        listed = self.listed.get()
        listed_at = listed[0] if listed else None
        if listed_at is None:
            listed_at = self._count(clicks)
        accepted = clicks if listed_at is None else clicks[clicks["click_micros"] <= listed_at]
        yield accepted[self.columns]

    def _count(self, clicks: pd.DataFrame) -> int | None:
        """Adds the clicks to the counts; the time of the first that brings one of them to the threshold."""
        groups = clicks.groupby(["click_day", "adid"], sort=False)
        reached, totals = [], {}
        for (day, ad), group in groups:
            known = self.counts.getValue((int(day), int(ad)))
            before = known[0] if known else 0
            totals[(int(day), int(ad))] = before + len(group)
            if before + len(group) >= self.threshold:
                reached.append(int(group["click_micros"].iloc[max(self.threshold - before, 1) - 1]))
        if reached:
            self.listed.update((min(reached),))
            self.counts.clear()
            return min(reached)
        for entry, n in totals.items():
            self.counts.updateValue(entry, (n,))
        oldest = max(day for day, _ in totals) - self.kept_days
        for entry in [entry for entry in self.counts.keys() if entry[0] < oldest]:
            self.counts.removeKey(entry)
        return None

    def close(self) -> None:
        pass


def accepted_stream(clicks: DataFrame, threshold: int = DEFAULT_THRESHOLD, tie: str = "event_id", kept_days: int = KEPT_DAYS) -> DataFrame:
    """Clicks up to the moment their user is blacklisted, decided click by click, for append mode.

    On clicks that come in the order of (ts, ``tie``) the result is that of ``operators.ads.accepted_clicks`` however they are cut into
    batches; inside a batch they are put into that order. A user's counts are kept for ``kept_days`` before the newest day seen of the user;
    a listed user's state is one number. The clicks of one user in one batch are held in memory: the source's limit on a batch bounds them.
    Column names must not begin with an underscore, as Spark hands rows over as named tuples.
    """
    columns = clicks.columns
    keyed = clicks.withColumns({"click_micros": F.unix_micros(F.col("ts").cast("timestamp")), "click_day": F.unix_date(F.to_date("ts"))})
    return keyed.groupBy("userid").transformWithStateInPandas(
        AcceptedClicks(columns, threshold, tie, kept_days), outputStructType=clicks.schema, outputMode="Append", timeMode="None")
