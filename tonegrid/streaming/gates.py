"""Streaming forms: levels per channel and time window as events arrive, with late ones up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_levels(events: DataFrame, threshold: float, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(channel, start, events, rms, clipped_pct, status) of (channel, ts, x), batch or stream."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    levels = events.withWatermark("ts", late).groupBy("channel", at.alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), (100.0 * F.avg((F.abs("x") >= threshold).cast("double"))).alias("clipped_pct")
    )
    status = F.when(F.col("clipped_pct") > 0, "warning").otherwise("pass")
    return levels.select("channel", F.col("w.start").alias("start"), "events", "rms", "clipped_pct", status.alias("status"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(channel, start, end, events, peak) of runs of events without a longer gap."""
    s = events.withWatermark("ts", late).groupBy("channel", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max(F.abs("x")).alias("peak"))
    return s.select("channel", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "peak")
