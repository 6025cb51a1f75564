"""Queries of the streaming operators on the events table, read as a batch; tests run them as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegrid.functions.columns import round4
from tonegrid.sources.signals import table
from tonegrid.streaming import gates


def _events(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"))


def windowed_levels(spark, d):
    out = gates.windowed_levels(_events(spark, d), 120.0, window="6 hours")
    return round4(out.withColumn("start", F.unix_timestamp("start")), "rms", "clipped_pct")


def event_sessions(spark, d):
    out = gates.sessions(_events(spark, d), "10 minutes")
    return round4(out.withColumns({"start": F.unix_micros("start"), "end": F.unix_micros("end")}), "peak")


QUERIES = {"windowed_levels": windowed_levels, "event_sessions": event_sessions}
ORACLES = {
    "windowed_levels": """
SELECT event_type AS channel, CAST(epoch_us(ts) // 21600000000 * 21600 AS BIGINT) AS start, count(*) AS events, round(sqrt(avg(value * value)), 4) AS rms,
       round(100.0 * count(*) FILTER (WHERE abs(value) >= 120.0) / count(*), 4) AS clipped_pct, CASE WHEN count(*) FILTER (WHERE abs(value) >= 120.0) > 0 THEN 'warning' ELSE 'pass' END AS status
FROM events GROUP BY event_type, epoch_us(ts) // 21600000000""",
    "event_sessions": """
WITH g AS (SELECT event_type AS channel, epoch_us(ts) AS t, value AS x, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) < 600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT channel, min(t) AS start, max(t) + 600000000 AS "end", count(*) AS events, round(max(abs(x)), 4) AS peak FROM s GROUP BY channel, s""",
}
