"""Spectral descriptors of (vec_id, label, bin, mag) rows: one grouping by frame, or windows over its bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions.columns import power_db

def frame():
    return Window.partitionBy("vec_id")


def in_bins():
    return Window.partitionBy("vec_id").orderBy("bin")


def spectral_health(spec: DataFrame) -> DataFrame:
    """(vec_id, centroid, flatness): magnitude centroid in bins, geometric over arithmetic mean."""
    return spec.groupBy("vec_id").agg(
        F.try_divide(F.sum(F.col("bin") * F.col("mag")), F.sum("mag")).alias("centroid"),
        (F.exp(F.avg(F.log(F.col("mag") + 1e-12))) / (F.avg("mag") + 1e-12)).alias("flatness"),
    )


def rolloff(spec: DataFrame, share: float = 0.85) -> DataFrame:
    """(vec_id, rolloff_bin): the first bin at which the running magnitude reaches ``share`` of all."""
    running = spec.withColumn("upto", F.sum("mag").over(in_bins())).withColumn("all", F.sum("mag").over(frame()))
    return running.where(F.col("upto") >= share * F.col("all")).groupBy("vec_id").agg(F.min("bin").alias("rolloff_bin"))


def irregularity(spec: DataFrame) -> DataFrame:
    """(vec_id, irregularity): mean step between bins over mean magnitude, at most 1."""
    steps = spec.withColumn("step", F.abs(F.col("mag") - F.lag("mag").over(in_bins())))
    return steps.groupBy("vec_id").agg(F.least(F.lit(1.0), F.avg("step") / (F.avg("mag") + 1e-12)).alias("irregularity"))


def thirds(spec: DataFrame) -> DataFrame:
    """``spec`` with ``third`` (0, 1, 2): the place of the frame among its label's frames."""
    frames = spec.select("label", "vec_id").distinct()
    place = Window.partitionBy("label").orderBy("vec_id")
    placed = frames.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label"))).withColumn("i", F.row_number().over(place) - 1)
    cut = F.floor(F.col("n") / 3)
    third = F.when(F.col("i") < cut, 0).when(F.col("i") >= F.col("n") - cut, 2).otherwise(1)
    return spec.join(placed.select("label", "vec_id", third.alias("third")), ["label", "vec_id"])


def timbre_distance(spec: DataFrame) -> DataFrame:
    """(label, timbre_distance): 1 less the cosine of the mean spectra of a label's first and last third."""
    means = thirds(spec).where("third <> 1").groupBy("label", "bin").agg(
        F.avg(F.when(F.col("third") == 0, F.col("mag"))).alias("a"), F.avg(F.when(F.col("third") == 2, F.col("mag"))).alias("b")
    )
    dot = lambda x, y: F.sum(F.col(x) * F.col(y))
    cosine = F.try_divide(dot("a", "b"), F.sqrt(dot("a", "a") * dot("b", "b")))
    return means.groupBy("label").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(cosine, F.lit(0.0)))).alias("timbre_distance"))


def fatigue(spec: DataFrame, high: int) -> DataFrame:
    """(label, fatigue_index): 1 less the share of energy from bin ``high`` on, last third over first, within -1 and 1."""
    def energy(third: int, above: bool) -> Column:
        mine = (F.col("third") == third) & ((F.col("bin") >= high) if above else F.lit(True))
        return F.sum(F.when(mine, F.col("mag") * F.col("mag")))

    per = thirds(spec).groupBy("label").agg(*[energy(t, a).alias(f"e{t}{int(a)}") for t in (0, 2) for a in (False, True)])
    ratio = F.try_divide(F.col("e21") / F.col("e20"), F.col("e01") / F.col("e00"))
    return per.select("label", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - ratio)).alias("fatigue_index"))


def scene_angles(spec: DataFrame, degrees: float) -> DataFrame:
    """(label, frames, scene_changes, largest_angle): angles between consecutive frames of a label, in decibels."""
    vectors = spec.groupBy("label", "vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "mag"))), lambda s: power_db(s["mag"] * s["mag"])).alias("v"))
    pair = vectors.withColumn("w", F.lag("v").over(Window.partitionBy("label").orderBy("vec_id")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = F.try_divide(dot("v", "w"), F.sqrt(dot("v", "v") * dot("w", "w")))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return pair.withColumn("angle", angle).groupBy("label").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("angle") > degrees).alias("scene_changes"), F.max("angle").alias("largest_angle")
    )


def artifact_frames(spec: DataFrame, low: int, high: int, over_low: float, over_high: float) -> DataFrame:
    """(label, frames, artifact_frames): frames whose lowest or highest bins stand out of their mean level."""
    level = lambda c: 20.0 * F.log10(F.avg(c) + 1e-12)
    per = spec.groupBy("label", "vec_id").agg(
        level(F.col("mag")).alias("all"), level(F.when(F.col("bin") < low, F.col("mag"))).alias("low"), level(F.when(F.col("bin") >= high, F.col("mag"))).alias("high")
    )
    odd = (F.col("low") - F.col("all") > over_low) | (F.col("high") - F.col("all") > over_high)
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("frames"), F.count_if(odd).alias("artifact_frames"))


def bandwidth(spec: DataFrame, edge: int, drop_db: float) -> DataFrame:
    """(vec_id, aliasing_level_db, bandwidth_bin): power about ``edge`` against the lower quarter; the last bin within ``drop_db`` of the largest."""
    power = spec.withColumn("p", F.col("mag") * F.col("mag")).withColumn("top", F.max(F.col("mag") * F.col("mag")).over(frame()))
    near = F.avg(F.when(F.col("bin").between(int(edge * 0.9), int(edge * 1.1)), F.col("p")))
    low = F.avg(F.when(F.col("bin") < edge // 2, F.col("p")))
    within = F.max(F.when(power_db(F.col("p")) - power_db(F.col("top")) > drop_db, F.col("bin")))
    return power.groupBy("vec_id").agg((power_db(near) - power_db(low)).alias("aliasing_level_db"), within.alias("bandwidth_bin"))


def harmonic_tension(spec: DataFrame, harmonics: int = 9) -> DataFrame:
    """(vec_id, f0_bin, harmonic_tension): 1 less the energy within a bin of the multiples of the strongest bin."""
    strongest = F.first("bin").over(frame().orderBy(F.col("mag").desc(), "bin"))
    found = spec.where("bin > 0").withColumn("f0", strongest)
    number = F.round(F.col("bin") / F.col("f0"))
    near = (F.abs(F.col("bin") - number * F.col("f0")) <= 1) & number.between(1, harmonics)
    e = F.col("mag") * F.col("mag")
    return found.groupBy("vec_id", F.col("f0").alias("f0_bin")).agg((1 - F.coalesce(F.sum(F.when(near, e)), F.lit(0.0)) / F.sum(e)).alias("harmonic_tension"))


def inharmonicity(spec: DataFrame, reach: int = 2, last: int = 7) -> DataFrame:
    """(vec_id, inharmonicity): mean relative distance of the strongest bin near each multiple from that multiple."""
    strongest = F.first("bin").over(frame().orderBy(F.col("mag").desc(), "bin"))
    near = spec.where("bin > 0").withColumn("f0", strongest).withColumn("h", F.explode(F.sequence(F.lit(2), F.lit(last))))
    near = near.where(F.abs(F.col("bin") - F.col("h") * F.col("f0")) <= reach)
    peaks = near.groupBy("vec_id", "f0", "h").agg(F.min_by("bin", F.struct(-F.col("mag"), F.col("bin"))).alias("at"))
    return peaks.groupBy("vec_id").agg(F.avg(F.abs(F.col("at") / (F.col("h") * F.col("f0")) - 1)).alias("inharmonicity"))


def fingerprint(spec: DataFrame, every: int = 2) -> DataFrame:
    """(label, bits, fingerprint_sha256): bits of every ``every``-th bin above its frame's mean power, of all frames in order."""
    bits = spec.withColumn("mean", F.avg(F.col("mag") * F.col("mag")).over(frame())).where(F.col("bin") % every == 0)
    bit = F.when(F.col("mag") * F.col("mag") > F.col("mean"), "1").otherwise("0")
    joined = bits.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "bin", bit.alias("b")))), lambda s: s["b"]), "").alias("b"))
    return joined.select("label", F.length("b").cast("long").alias("bits"), F.sha2("b", 256).alias("fingerprint_sha256"))


def dft_bin(signal: DataFrame, cycles: float) -> DataFrame:
    """(channel, amplitude, phase): one bin of the discrete Fourier transform, ``cycles`` per frame."""
    angle = 2 * 3.141592653589793 * cycles * F.col("frame")
    sums = signal.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(-F.col("x") * F.sin(angle)).alias("im"))
    return sums.select("channel", (2 * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")).alias("amplitude"), F.atan2("im", "re").alias("phase"))
