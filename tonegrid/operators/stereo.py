"""Channel relations: goniometer, balance, correlation matrices, signal-to-distortion ratios, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.functions.columns import db, lufs, rms


def correlation(n: str, a: str, b: str) -> Column:
    """Pearson correlation from running means; 0 where either side is constant."""
    ma, mb, mab, maa, mbb = (F.col(f"{n}{x}") for x in ("ma", "mb", "mab", "maa", "mbb"))
    spread = F.sqrt(F.greatest(F.lit(0.0), maa - ma * ma) * F.greatest(F.lit(0.0), mbb - mb * mb))
    return F.coalesce(F.try_divide(mab - ma * mb, F.when(spread > 1e-12, spread)), F.lit(0.0))


def moments(n: str, a: Column, b: Column) -> list[Column]:
    return [F.avg(a).alias(f"{n}ma"), F.avg(b).alias(f"{n}mb"), F.avg(a * b).alias(f"{n}mab"), F.avg(a * a).alias(f"{n}maa"), F.avg(b * b).alias(f"{n}mbb")]


def goniometer(stereo: DataFrame) -> DataFrame:
    """(channel, mean_correlation, balance, width, out_of_phase) of (channel, frame, l, r)."""
    l, r = F.col("l"), F.col("r")
    per = stereo.groupBy("channel").agg(
        *moments("", l, r), F.stddev_pop((l - r) / F.sqrt(F.lit(2.0))).alias("width"), F.avg((l * r < 0).cast("double")).alias("out_of_phase")
    )
    return per.select(
        "channel", correlation("", "l", "r").alias("mean_correlation"),
        F.coalesce(F.try_divide(F.col("maa") - F.col("mbb"), F.col("maa") + F.col("mbb")), F.lit(0.0)).alias("balance"), "width", "out_of_phase",
    )


def channel_balance(stereo: DataFrame, most_lufs: float = 1.0, most_rms: float = 2.0) -> DataFrame:
    """(channel, delta_lufs, delta_rms_db, status): left against right."""
    per = stereo.groupBy("channel").agg(F.avg(F.col("l") * F.col("l")).alias("ml"), F.avg(F.col("r") * F.col("r")).alias("mr"), rms(F.col("l")).alias("rl"), rms(F.col("r")).alias("rr"))
    out = per.select("channel", F.abs(lufs(F.col("ml")) - lufs(F.col("mr"))).alias("delta_lufs"), F.abs(db(F.col("rl")) - db(F.col("rr"))).alias("delta_rms_db"))
    return out.withColumn("status", F.when((F.col("delta_lufs") > most_lufs) | (F.col("delta_rms_db") > most_rms), "warning").otherwise("pass"))


def mono_loss(stereo: DataFrame, most_db: float = 6.0) -> DataFrame:
    """(channel, mono_loss_db, status): what the louder channel loses in the mono sum."""
    per = stereo.groupBy("channel").agg(rms(F.col("l")).alias("l"), rms(F.col("r")).alias("r"), rms(0.5 * F.col("l") + 0.5 * F.col("r")).alias("m"))
    loss = F.greatest(F.lit(0.0), F.greatest(db(F.col("l")), db(F.col("r"))) - db(F.col("m")))
    return per.select("channel", loss.alias("mono_loss_db")).withColumn("status", F.when(F.col("mono_loss_db") >= most_db, "warning").otherwise("pass"))


def correlation_matrix(long: DataFrame, most: float = 0.95) -> DataFrame:
    """(a, b, correlation, status) for every pair of channels of (channel, frame, x) with common frames.

    One row per pair and frame within a frame only: the join is on the frame, and a layout has few channels.
    """
    a = long.select("frame", F.col("channel").alias("a"), F.col("x").alias("xa"))
    b = long.select("frame", F.col("channel").alias("b"), F.col("x").alias("xb"))
    per = a.join(b, "frame").where("a < b").groupBy("a", "b").agg(*moments("", F.col("xa"), F.col("xb")))
    out = per.select("a", "b", correlation("", "a", "b").alias("correlation"))
    return out.withColumn("status", F.when(F.abs("correlation") > most, "warning").otherwise("pass"))


def si_sdr(pairs: DataFrame) -> DataFrame:
    """(pair, si_sdr_db) of (pair, frame, ref, deg): the reference's projection against the rest, in dB."""
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    per = pairs.groupBy("pair").agg(dot("ref", "deg").alias("rd"), dot("ref", "ref").alias("rr"), dot("deg", "deg").alias("dd"))
    target = F.try_divide(F.col("rd") * F.col("rd"), F.col("rr"))
    rest = F.greatest(F.lit(0.0), F.col("dd") - target)
    return per.select("pair", (10 * F.log10((target + 1e-12) / (rest + 1e-12))).alias("si_sdr_db"))


def leakage(pairs: DataFrame, most_pct: float = 10.0) -> DataFrame:
    """(stem, leakage_pct, status) of (stem, other, frame, x, y): positive projections on the other stems, of the stem's energy."""
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    per = pairs.groupBy("stem", "other").agg(dot("x", "y").alias("xy"), dot("y", "y").alias("yy"), dot("x", "x").alias("xx"))
    onto = F.when(F.col("xy") > 0, F.try_divide(F.col("xy") * F.col("xy"), F.col("yy"))).otherwise(0.0)
    out = per.groupBy("stem").agg((100.0 * F.sum(onto) / F.max("xx")).alias("leakage_pct"))
    return out.withColumn("status", F.when(F.col("leakage_pct") > most_pct, "warning").otherwise("pass"))


def layout_checks(multi: DataFrame, low: int, least_pct: float = 80.0) -> DataFrame:
    """(subject, lfe_low_pct, centre_rms, status) of (subject, channel, bin, mag): channel 3 keeps to bins under ``low``, channel 2 isn't silent."""
    e = F.col("mag") * F.col("mag")
    lfe = F.col("channel") == 3
    per = multi.groupBy("subject").agg(
        (100.0 * F.sum(F.when(lfe & (F.col("bin") < low), e)) / F.sum(F.when(lfe, e))).alias("lfe_low_pct"),
        F.sqrt(F.avg(F.when(F.col("channel") == 2, e))).alias("centre_rms"),
    )
    return per.withColumn("status", F.when((F.col("lfe_low_pct") < least_pct) | (F.col("centre_rms") < 1e-6), "warning").otherwise("pass"))
