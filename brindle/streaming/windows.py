"""Counts in event-time windows. The same functions work on streams and on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(df: DataFrame, window: Column, by: str) -> DataFrame:
    return (
        df.groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            by, "n",
        )
    )


def tumbling_counts(df: DataFrame, at: str, by: str, length: str) -> DataFrame:
    return _counted(df, F.window(at, length), by)


def hopping_counts(df: DataFrame, at: str, by: str, length: str, every: str) -> DataFrame:
    return _counted(df, F.window(at, length, every), by)


def session_counts(df: DataFrame, at: str, by: str, gap: str) -> DataFrame:
    """Sessions end ``gap`` after their last row."""
    return _counted(df, F.session_window(at, gap), by)
