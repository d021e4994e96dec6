"""Running word count."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clickweave.operators.words import word_count


def running_word_count(lines: DataFrame) -> DataFrame:
    """Words of all lines seen so far, for complete or update mode. There is no event time in the
    lines, so the state is one row per distinct word."""
    return word_count(lines)
