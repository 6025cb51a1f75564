"""Defects as runs and edges: clipping, clicks, dropouts, repetitions, loop jumps, onsets.

Runs are gaps and islands: consecutive frames less their rank are one constant. Every window is
partitioned by channel; a channel is what a task must see whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions.columns import by_channel


def islands(marked: DataFrame, least: int = 1, *more: Column) -> DataFrame:
    """(channel, start, length, ...) of runs of consecutive frames of ``marked`` of at least ``least`` frames."""
    group = F.col("frame") - F.row_number().over(by_channel())
    runs = marked.withColumn("__run", group).groupBy("channel", "__run")
    return runs.agg(F.min("frame").alias("start"), F.count(F.lit(1)).alias("length"), *more).where(F.col("length") >= least).drop("__run")


def clipping(signal: DataFrame, threshold: float, most_pct: float) -> DataFrame:
    """(channel, clipped_pct, status): fail above ``most_pct``, warning for any clipped frame."""
    share = signal.groupBy("channel").agg((100.0 * F.avg((F.abs("x") >= threshold).cast("double"))).alias("clipped_pct"))
    status = F.when(F.col("clipped_pct") > most_pct, "fail").when(F.col("clipped_pct") > 0, "warning").otherwise("pass")
    return share.withColumn("status", status)


def clipping_runs(signal: DataFrame, threshold: float, least: int) -> DataFrame:
    return islands(signal.where(F.abs("x") >= threshold), least)


def clicks(signal: DataFrame, sensitivity: float) -> DataFrame:
    """(channel, start, length): second differences above ``sensitivity`` times their RMS, neighbours as one."""
    w = by_channel()
    d2 = signal.withColumn("d2", F.lead("x").over(w) - 2 * F.col("x") + F.lag("x").over(w)).where("d2 IS NOT NULL")
    return islands(d2.withColumn("level", F.sqrt(F.avg(F.col("d2") * F.col("d2")).over(Window.partitionBy("channel"))) + 1e-12).where(F.abs("d2") > sensitivity * F.col("level")))


def dropouts(signal: DataFrame, threshold: float, least: int, context: float) -> DataFrame:
    """(channel, start, length, context_rms): quiet runs within loud surroundings of four times ``least`` frames either side."""
    quiet = islands(signal.where(F.abs("x") < threshold), least)
    sums = signal.withColumn("s", F.sum(F.col("x") * F.col("x")).over(by_channel().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = signal.groupBy("channel").agg(F.max("frame").alias("last"))
    asked = quiet.join(ends, "channel").select(
        "channel", "start", "length", F.greatest(F.lit(0), F.col("start") - 4 * least).alias("a"), F.least(F.col("last"), F.col("start") + F.col("length") - 1 + 4 * least).alias("b")
    )
    upto = sums.select("channel", F.col("frame").alias("b"), F.col("s").alias("upto"))
    before = sums.select("channel", (F.col("frame") + 1).alias("a"), F.col("s").alias("before"))
    near = asked.join(upto, ["channel", "b"]).join(before, ["channel", "a"], "left")
    near = near.withColumn("context_rms", F.sqrt((F.col("upto") - F.coalesce("before", F.lit(0.0))) / (F.col("b") - F.col("a") + 1)))
    return near.where((F.col("b") - F.col("a") + 1 > F.col("length")) & (F.col("context_rms") >= context * threshold)).select("channel", "start", "length", "context_rms")


def repetitions(signal: DataFrame, lengths: tuple, tolerance: float) -> DataFrame:
    """(channel, lag, start): windows of ``lag`` frames that equal the ``lag`` frames after them."""
    def of(n: int) -> DataFrame:
        same = F.coalesce((F.abs(F.col("x") - F.lead("x", n).over(by_channel())) < tolerance).cast("int"), F.lit(0))
        ahead = by_channel().rowsBetween(0, n - 1)
        found = signal.withColumn("same", same).withColumn("all", F.sum("same").over(ahead))
        return found.where(F.col("all") == n).select("channel", F.lit(n).cast("long").alias("lag"), F.col("frame").alias("start"))

    return reduce(DataFrame.union, [of(n) for n in lengths])


def loop_jump(signal: DataFrame, amplitude: float, slope: float) -> DataFrame:
    """(channel, jump, slope_jump, status): what a loop from the last frame to the first would do."""
    ends = loop_ends(signal)
    jump = F.abs(F.col("last") - F.col("first"))
    turn = F.abs((F.col("second") - F.col("first")) - (F.col("last") - F.col("last_but_one")))
    return ends.where("n > 1").select("channel", jump.alias("jump"), turn.alias("slope_jump"), F.when((jump > amplitude) | (turn > slope), "fail").otherwise("pass").alias("status"))


def loop_ends(signal: DataFrame) -> DataFrame:
    return (
        signal.withColumn("before", F.lag("x").over(by_channel())).groupBy("channel")
        .agg(
            F.min_by("x", "frame").alias("first"), F.max_by("x", "frame").alias("last"), F.count(F.lit(1)).alias("n"),
            F.min(F.when(F.col("frame") == 1, F.col("x"))).alias("second"), F.max_by("before", "frame").alias("last_but_one"),
        )
    )


def envelope(signal: DataFrame, taps: int) -> DataFrame:
    """``signal`` with its rectified moving mean over ``taps`` frames."""
    around = by_channel().rowsBetween(-(taps // 2), taps - taps // 2 - 1)
    return signal.withColumn("env", F.avg(F.abs("x")).over(around))


def quantiles(values: DataFrame, of: str, share: float) -> DataFrame:
    """(channel, limit): an interpolated quantile of each channel, its weighted sum rounded once, as ``quantile_cont`` of the SQL has it.

    What is compared with the limit may equal either of its two neighbours but for the last bit, so that bit counts.
    """
    channel = Window.partitionBy("channel")
    at = (F.count(of).over(channel) - 1) * F.lit(share)
    ranked = values.where(F.col(of).isNotNull()).select("channel", F.col(of).alias("v"), at.alias("at"), (F.row_number().over(channel.orderBy(of)) - 1).alias("rank"))
    ends = ranked.groupBy("channel", "at").agg(*[F.max(F.when(F.col("rank") == end("at"), F.col("v"))).alias(name) for name, end in (("low", F.floor), ("high", F.ceil))])
    part = F.col("at") - F.floor("at")
    # Spark has no such function of its own; a row for each channel comes here
    between = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), F.col("low"), 1 - part, F.col("high") * part).cast("double")
    return ends.select("channel", F.when(part == 0, F.col("low")).otherwise(between).alias("limit"))


def onsets(signal: DataFrame, taps: int, quantile: float) -> DataFrame:
    """(channel, frame): rising edges of the envelope's step above its quantile among rising steps."""
    steps = envelope(signal, taps).withColumn("d", F.col("env") - F.lag("env").over(by_channel())).where("d IS NOT NULL")
    over = steps.join(quantiles(steps.where("d > 0"), "d", quantile), "channel").withColumn("over", F.col("d") > F.col("limit"))
    return over.withColumn("was", F.lag("over").over(by_channel())).where("over AND NOT coalesce(was, false)").select("channel", "frame")


def onset_regularity(signal: DataFrame, taps: int, quantile: float, least: int) -> DataFrame:
    """(channel, onsets, regularity): 1 less the variation of the distances of at least ``least`` onsets."""
    gaps = onsets(signal, taps, quantile).withColumn("gap", F.col("frame") - F.lag("frame").over(by_channel()))
    stats = gaps.groupBy("channel").agg(F.count(F.lit(1)).alias("onsets"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("mean"))
    return stats.where(F.col("onsets") >= least).select("channel", "onsets", F.greatest(F.lit(0.0), 1 - F.try_divide("sd", "mean")).alias("regularity"))


def crossings(signal: DataFrame, level: float, rate: float) -> DataFrame:
    """(channel, rate_hz): rising crossings of ``level`` times the largest deviation from the mean, per second."""
    everything = Window.partitionBy("channel")
    centred = signal.withColumn("c", F.abs(F.col("x") - F.avg("x").over(everything)))
    over = centred.withColumn("over", F.col("c") > level * F.max("c").over(everything))
    edges = over.withColumn("edge", F.col("over") & ~F.coalesce(F.lag("over").over(by_channel()), F.lit(False)))
    return edges.groupBy("channel").agg((F.count_if("edge") * rate / F.count(F.lit(1))).alias("rate_hz"))

