"""Event-time windows: the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, delay: str | None) -> DataFrame:
    return events.withWatermark("ts", delay) if delay else events


def tumbling(events: DataFrame, size: str = "1 day", delay: str | None = None) -> DataFrame:
    """Counts and sums by window and type; with a delay, late rows are dropped and closed windows emitted."""
    grouped = watermarked(events, delay).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 day", step: str = "6 hours", delay: str | None = None) -> DataFrame:
    grouped = watermarked(events, delay).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str | None = None) -> DataFrame:
    grouped = watermarked(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), "n")
