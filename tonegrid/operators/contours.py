"""Contours and attacks: melodic direction, pitch drift, attack times, phase jumps of a signal (channel, frame, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions.columns import by_channel
from tonegrid.operators.runs import onsets


def melodic_contour(track: DataFrame, rise: float = 5.0) -> DataFrame:
    """(channel, slope, direction, semitones) of a frequency track in frames; values that aren't positive are unvoiced."""
    t, x = F.col("frame").cast("double"), F.col("x")
    per = track.where("x > 0").groupBy("channel").agg(
        F.avg(t).alias("mt"), F.avg(x).alias("mx"), F.avg(t * x).alias("tx"), F.avg(t * t).alias("tt"), F.max(x).alias("high"), F.min(x).alias("low")
    )
    slope = F.coalesce(F.try_divide(F.col("tx") - F.col("mt") * F.col("mx"), F.col("tt") - F.col("mt") * F.col("mt")), F.lit(0.0))
    direction = F.when(slope > rise, "rising").when(slope < -rise, "falling").otherwise("stable")
    return per.select("channel", slope.alias("slope"), direction.alias("direction"), (12 * F.log2(F.col("high") / F.col("low"))).alias("semitones"))


def pitch_drift(track: DataFrame, most_cents: float = 50.0, least: int = 4) -> DataFrame:
    """(channel, voiced, drift_cents, status): range of the track in cents after a median of five."""
    five = by_channel().rowsBetween(-2, 2)
    near = F.array_sort(F.collect_list("x").over(five))  # five values at most
    middle = lambda i: F.get(F.col("near"), i.cast("int"))
    voiced = track.where("x > 0").withColumn("near", near)
    voiced = voiced.withColumn("smooth", (middle(F.floor((F.size("near") - 1) / 2)) + middle(F.floor(F.size("near") / 2))) / 2)
    per = voiced.groupBy("channel").agg(F.count(F.lit(1)).alias("voiced"), (1200 * F.log2(F.max("smooth") / F.min("smooth"))).alias("drift_cents"))
    status = F.when(F.col("voiced") < least, "not_applicable").when(F.col("drift_cents") > most_cents, "warning").otherwise("pass")
    return per.withColumn("status", status)


def attack_times(signal: DataFrame, taps: int, quantile: float, reach: int, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(channel, onsets, slowest_attack): frames from ``low`` to ``high`` of the peak within ``reach`` frames after each onset.

    Onsets and samples meet by frame: every onset names the frames it reaches.
    """
    starts = onsets(signal, taps, quantile).select("channel", F.col("frame").alias("onset"))
    asked = starts.select("channel", "onset", F.explode(F.sequence(F.col("onset"), F.col("onset") + reach - 1)).alias("frame"))
    near = asked.join(signal.select("channel", "frame", F.abs("x").alias("a")), ["channel", "frame"])
    peak = F.max("a").over(Window.partitionBy("channel", "onset"))
    per = near.withColumn("peak", peak).groupBy("channel", "onset").agg(
        F.min(F.when(F.col("a") >= low * F.col("peak"), F.col("frame"))).alias("t1"), F.min(F.when(F.col("a") >= high * F.col("peak"), F.col("frame"))).alias("t2")
    )
    return per.groupBy("channel").agg(F.count(F.lit(1)).alias("onsets"), F.max(F.greatest(F.lit(0), F.col("t2") - F.col("t1"))).alias("slowest_attack"))


def phase_jumps(signal: DataFrame, cycles: float, size: int, hop: int, most: float = 1.0) -> DataFrame:
    """(channel, windows, jumps): changes of one frequency's phase from window to window beyond what it turns by itself."""
    turn, pi = 2 * 3.141592653589793, 3.141592653589793
    first = F.greatest(F.lit(0), F.floor((F.col("frame") - size) / hop) + 1)
    covered = signal.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("frame") / hop))))
    angle = turn * cycles * F.col("frame")  # absolute frames, so a steady tone keeps its phase
    per = covered.groupBy("channel", "window").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(-F.col("x") * F.sin(angle)).alias("im"))
    phase = per.where(F.col("n") == size).withColumn("phase", F.atan2("im", "re"))
    step = F.col("phase") - F.lag("phase").over(Window.partitionBy("channel").orderBy("window"))
    wrapped = step - turn * F.floor((step + pi) / turn)
    return phase.withColumn("jump", F.abs(wrapped) > most).groupBy("channel").agg(F.count(F.lit(1)).alias("windows"), F.count_if("jump").alias("jumps"))
