"""Scalar helpers as column expressions; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


ACTION_TIME = r"^\d{4}-\d\d-\d\d \d{1,2}:\d\d:\d\d$"


# ---- ids, names and lists -------------------------------------------------------------------

def concat_id_name(id_col: Column, name_col: Column, sep: str = ":") -> Column:
    """``id`` + separator + ``name``; null when either part is null."""
    return F.concat(id_col.cast("string"), F.lit(sep), name_col)


def json_field(json_col: Column, field: str) -> Column:
    """Top-level field of a JSON text, as text."""
    return F.get_json_object(json_col, f"$.{field}")


def csv_values(col: Column) -> Column:
    """Distinct numbers of a comma list (array of bigint), blanks around them or not; entries that are no numbers are one null."""
    return F.array_distinct(F.split(col, ",").try_cast("array<bigint>"))


def trim_comma(col: Column) -> Column:
    """Without the commas at either end."""
    return F.btrim(col, F.lit(","))


def pad2(col: Column) -> Column:
    """Two digits; longer text is left alone."""
    text = col.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def is_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) == ""


def is_not_empty(col: Column) -> Column:
    return ~is_empty(col)


# ---- packed "k=v|k=v" text ------------------------------------------------------------------

def kv_get(packed: Column, key: str, delimiter: str = "|") -> Column:
    """Value of ``key``; null when it is missing, empty or itself contains ``=``."""
    d = re.escape(delimiter)
    pattern = rf"(?:^|{d})\Q{key}\E=([^={d}]+)=*(?={d}|$)"
    return F.nullif(F.regexp_extract(packed, pattern, 1), F.lit(""))


def kv_set(packed: Column, key: str, value: str, delimiter: str = "|") -> Column:
    """The text with the value of ``key`` replaced; an absent key is not added, the order is kept."""
    d = re.escape(delimiter)
    pattern = rf"(^|{d})\Q{key}\E(?:=[^{d}]*)?(?={d}|$)"
    literal = f"{key}={value}".replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(packed, pattern, f"$1{literal}")


# ---- dates and times ------------------------------------------------------------------------

def parse_action_time(col: Column) -> Column:
    """``yyyy-MM-dd H:mm:ss`` text, hour padded or not; any other text gives null.

    The native cast takes one-digit hours and is far cheaper per row than a pattern formatter, but would also read a
    bare time as today's and a bare year as its first day; the pattern keeps such text out.
    """
    return F.when(F.regexp_like(col, F.lit(ACTION_TIME)), col.try_cast("timestamp"))


def time_before(a: Column, b: Column) -> Column:
    return parse_action_time(a) < parse_action_time(b)


def time_after(a: Column, b: Column) -> Column:
    return parse_action_time(a) > parse_action_time(b)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds from ``earlier`` to ``later`` (timestamps)."""
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def format_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def format_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def date_hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH")


def format_date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def parse_date_key(col: Column) -> Column:
    return F.to_date(col, "yyyyMMdd")


def format_time_minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def today_date() -> Column:
    return format_date(F.current_date())


def yesterday_date() -> Column:
    return format_date(F.date_sub(F.current_date(), 1))


# ---- numbers --------------------------------------------------------------------------------

def format_double(col: Column, scale: int = 2) -> Column:
    """Half-up rounding of the decimal text of a double."""
    return F.round(col, scale)
