"""Level measurements on blocks: gated loudness, loudness range, dynamic range, noise floor, SNR, decay time.

All take a signal (channel, frame, x). A frame belongs to every block that covers it, so blocks are
an explode and one grouping; a channel's gates are joins of small per-channel rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions.columns import db, lufs, power_mean, rms


def blocks(signal: DataFrame, size: int, hop: int) -> DataFrame:
    """(channel, block, ms, peak) of all whole blocks of ``size`` frames every ``hop``.

    Where hops fill a block exactly, frames are summed up by hop before anything is exchanged, and only these sums go to all blocks that cover them.
    """
    step = hop if size % hop == 0 else 1
    sums = signal.groupBy("channel", F.floor(F.col("frame") / step).alias("h")).agg(F.sum(F.col("x") * F.col("x")).alias("ss"), F.max(F.abs("x")).alias("peak"), F.count(F.lit(1)).alias("n"))
    first = F.greatest(F.lit(0), F.floor((F.col("h") * step - size) / hop) + 1)
    covered = sums.withColumn("block", F.explode(F.sequence(first, F.floor(F.col("h") * step / hop))))
    whole = covered.groupBy("channel", "block").agg((F.sum("ss") / F.sum("n")).alias("ms"), F.max("peak").alias("peak"), F.sum("n").alias("n"))
    return whole.where(F.col("n") == size).drop("n")


def gated_loudness(signal: DataFrame, size: int, hop: int, absolute: float = -70.0, relative: float = -10.0) -> DataFrame:
    """(channel, lufs): power mean of blocks above both gates; of those above the first if the second leaves none."""
    levels = blocks(signal, size, hop).select("channel", lufs(F.col("ms")).alias("l")).where(F.col("l") >= absolute)
    mean = 10.0 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("l") / 10.0)).over(Window.partitionBy("channel")))
    gated = power_mean(F.when(F.col("l") >= F.col("mean") + relative, F.col("l")))
    return levels.withColumn("mean", mean).groupBy("channel").agg(F.coalesce(gated, F.max("mean")).alias("lufs"))


def loudness_range(signal: DataFrame, size: int, hop: int, least: int = 4, absolute: float = -70.0, relative: float = -10.0) -> DataFrame:
    """(channel, lra): spread of the 10th to the 95th percentile of gated short-term levels, 0 for too few."""
    return range_of_levels(blocks(signal, size, hop).select("channel", lufs(F.col("ms")).alias("l")), least, absolute, relative)


def range_of_levels(levels: DataFrame, least: int = 4, absolute: float = -70.0, relative: float = -10.0) -> DataFrame:
    """(channel, lra) of levels (channel, l) in LUFS."""
    levels = levels.where(F.col("l") > absolute)
    gate = levels.groupBy("channel").agg(power_mean(F.col("l")).alias("mean"), F.count(F.lit(1)).alias("n"))
    spread = lambda p: F.greatest(F.lit(0.0), p[1] - p[0])
    per = levels.join(gate, "channel").withColumn("in", F.col("l") >= F.col("mean") + relative)
    out = per.groupBy("channel").agg(
        F.count_if("in").alias("gated"), F.max("n").alias("n"),
        F.percentile(F.when(F.col("in"), F.col("l")), F.array(F.lit(0.1), F.lit(0.95))).alias("p"),
        F.percentile("l", F.array(F.lit(0.1), F.lit(0.95))).alias("q"),
    )
    lra = F.when(F.col("n") < least, F.lit(0.0)).when(F.col("gated") < least, spread(F.col("q"))).otherwise(spread(F.col("p")))
    return out.select("channel", lra.alias("lra"))


def dynamic_range(signal: DataFrame, size: int, hop: int, share: int = 5) -> DataFrame:
    """(channel, dr): mean peak over mean RMS, in dB, of the loudest fifth of the blocks."""
    loud = Window.partitionBy("channel").orderBy(F.col("rms").desc(), "block")
    levels = blocks(signal, size, hop).withColumn("rms", F.sqrt("ms")).where("rms > 1e-12")
    ranked = levels.withColumn("rank", F.row_number().over(loud)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("channel")))
    top = ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / share)))
    return top.groupBy("channel").agg(F.greatest(F.lit(0.0), 20.0 * F.log10(F.avg("peak") / F.avg("rms"))).alias("dr"))


def noise_floor(signal: DataFrame, size: int) -> DataFrame:
    """(channel, noise_floor_db): 10th percentile of tumbling RMS, silent frames left out."""
    levels = blocks(signal, size, size).withColumn("rms", F.sqrt("ms")).where("rms > 1e-12")
    return levels.groupBy("channel").agg(db(F.percentile("rms", 0.1)).alias("noise_floor_db"))


def snr(signal: DataFrame, size: int) -> DataFrame:
    """(channel, snr_db): 90th over 10th percentile of tumbling RMS."""
    levels = blocks(signal, size, size).select("channel", F.sqrt("ms").alias("rms"))
    p = F.percentile("rms", F.array(F.lit(0.1), F.lit(0.9)))
    return levels.groupBy("channel").agg(p.alias("p")).select("channel", db((F.col("p")[1] + 1e-12) / (F.col("p")[0] + 1e-12)).alias("snr_db"))


def decay_time(signal: DataFrame, rate: float, down_to: float = -30.0, longest: float = 10.0) -> DataFrame:
    """(channel, rt60_s): slope of the energy that is still to come, fitted down to ``down_to`` dB."""
    to_come = Window.partitionBy("channel").orderBy(F.col("frame").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = signal.withColumn("e", F.sum(F.col("x") * F.col("x")).over(to_come)).withColumn("all", F.max("e").over(Window.partitionBy("channel")))
    curve = left.where("all > 0").select("channel", (F.col("frame") / rate).alias("t"), (10.0 * F.log10(F.col("e") / F.col("all") + 1e-12)).alias("d")).where(F.col("d") >= down_to)
    fit = curve.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("mt"), F.avg("d").alias("md"), F.avg(F.col("t") * F.col("d")).alias("td"), F.avg(F.col("t") * F.col("t")).alias("tt"))
    slope = F.try_divide(F.col("td") - F.col("mt") * F.col("md"), F.col("tt") - F.col("mt") * F.col("mt"))
    rt = F.when((F.col("n") > 1) & (slope < 0), F.least(F.lit(longest), F.greatest(F.lit(0.0), -60.0 / slope))).otherwise(F.lit(0.0))
    return fit.select("channel", rt.alias("rt60_s"))


def channel_summary(signal: DataFrame, rate: float) -> DataFrame:
    """(channel, frames, duration_s, peak, rms, dc): what a scan of a signal reports."""
    return signal.groupBy("channel").agg(
        F.count(F.lit(1)).alias("frames"), (F.count(F.lit(1)) / rate).alias("duration_s"),
        F.max(F.abs("x")).alias("peak"), rms(F.col("x")).alias("rms"), F.avg("x").alias("dc"),
    )
