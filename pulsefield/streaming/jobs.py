"""Streaming forms of the idempotent append, the weekly counts and the sessions of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_events(stream: DataFrame, key: str, at: str, lateness: str = "45 days") -> DataFrame:
    """Each event once; state is dropped after the lateness."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def weekly_counts(stream: DataFrame, at: str, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """Events per key and seven-day window from Sunday on, emitted when the window can't change any more."""
    w = F.window(at, "7 days", startTime="3 days").alias("w")
    counted = stream.withWatermark(at, lateness).groupBy(w, *keys).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.to_date("w.start").alias("week_start"), "n")


def sessions(stream: DataFrame, at: str, who: str, gap: str = "120 minutes", lateness: str = "1 day") -> DataFrame:
    """Runs of a person's events with less than the gap between them."""
    counted = stream.withWatermark(at, lateness).groupBy(F.session_window(at, gap).alias("w"), who).agg(F.count("*").alias("n"))
    return counted.select(who, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
