"""Event-time windows with watermarks: tumbling, sliding and session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_users(stream: DataFrame, width: str, late: str, slide: str | None = None, error: float = 0.02) -> DataFrame:
    """start, end, city, rows, users (approximate, relative error ``error``) per event-time window.

    Rows later than ``late`` behind the latest event are dropped, as the watermark allows no other answer; a null time
    belongs to no window.
    """
    timed = stream.filter("ts is not null").withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed.groupBy(w.alias("w"), "city").agg(F.count("*").alias("rows"), F.approx_count_distinct("user_id", error).alias("users"))
    return out.select("w.start", "w.end", "city", "rows", "users")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """user_id, start, end, rows: runs of a user's events with pauses below ``gap``."""
    timed = stream.filter("ts is not null").withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("rows"))
    return out.select("user_id", "w.start", "w.end", "rows")
