"""Quality against a reference: similarity of windows, spectral similarity, alignment, band losses, declared sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions.columns import power_db


def window_similarity(pairs: DataFrame, size: int, least: float = 0.6) -> DataFrame:
    """(pair, similarity, status) of (pair, frame, ref, deg): mean cosine of windows of ``size`` frames."""
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    windows = pairs.groupBy("pair", F.floor(F.col("frame") / size).alias("w")).agg(dot("ref", "deg").alias("rd"), dot("ref", "ref").alias("rr"), dot("deg", "deg").alias("dd"))
    cosine = F.coalesce(F.try_divide(F.col("rd"), F.sqrt(F.col("rr") * F.col("dd"))), F.lit(0.0))
    per = windows.groupBy("pair").agg(F.avg(cosine).alias("similarity"))
    return per.withColumn("status", F.when(F.col("similarity") < least, "warning").otherwise("pass"))


def spectral_quality(pairs: DataFrame, least: float = 3.5) -> DataFrame:
    """(pair, quality, status) of magnitude pairs: mean 2RD / (R² + D²), from 1 to 5."""
    r, d = F.col("ref"), F.col("deg")
    per = pairs.groupBy("pair").agg((1 + 4 * F.avg(2 * r * d / (r * r + d * d + 1e-12))).alias("quality"))
    return per.withColumn("status", F.when(F.col("quality") < least, "warning").otherwise("pass"))


def alignment(pairs: DataFrame, most: int) -> DataFrame:
    """(pair, lag, correlation): the lag within ``most`` frames at which reference and degraded correlate most, by size."""
    lags = pairs.select("pair", (F.col("frame")).alias("frame"), "ref").withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    deg = pairs.select("pair", F.col("frame").alias("at"), "deg")
    met = lags.withColumn("at", F.col("frame") + F.col("lag")).join(deg, ["pair", "at"])
    sums = met.groupBy("pair", "lag").agg(F.sum(F.col("ref") * F.col("deg")).alias("correlation"))
    first = Window.partitionBy("pair").orderBy(F.round(F.abs("correlation"), 9).desc(), "lag")
    return sums.withColumn("n", F.row_number().over(first)).where("n = 1").select("pair", "lag", "correlation")


def band_losses(pairs: DataFrame, edges: tuple[int, ...], most_db: float = 6.0) -> DataFrame:
    """(pair, worst_loss_db, side_mid_db, status) of spectra of two channels (ref, deg): what each band loses in the sum, and side against mid in the lowest."""
    band = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("frame"))) - 1
    l, r = F.col("ref"), F.col("deg")
    energy = lambda x: F.sum(x * x)
    per = pairs.withColumn("band", band).where(F.col("band").between(0, len(edges) - 2)).groupBy("pair", "band").agg(
        energy(l).alias("l"), energy(r).alias("r"), energy(0.5 * l + 0.5 * r).alias("m"), energy((l - r) / 2).alias("s")
    )
    loss = F.greatest(power_db(F.col("l")), power_db(F.col("r"))) - power_db(F.col("m"))
    low = F.max(F.when(F.col("band") == 0, power_db(F.col("s")) - power_db(F.col("m"))))
    out = per.groupBy("pair").agg(F.greatest(F.lit(0.0), F.max(loss)).alias("worst_loss_db"), low.alias("side_mid_db"))
    return out.withColumn("status", F.when(F.col("worst_loss_db") >= most_db, "warning").otherwise("pass"))


def declared_sizes(subjects: DataFrame, tolerance_pct: float = 1.0) -> DataFrame:
    """(file_id, difference_pct, status) of (file_id, declared, decoded): a warning beyond the tolerance, or where nothing is declared."""
    difference = 100.0 * F.abs(F.col("decoded") - F.col("declared")) / F.greatest(F.col("declared"), F.lit(1))
    status = F.when(F.col("declared").isNull() | (difference > tolerance_pct), "warning").otherwise("pass")
    return subjects.select("file_id", difference.alias("difference_pct"), status.alias("status"))


def intelligibility(levels: DataFrame, clarity: DataFrame, least: float = 0.6) -> DataFrame:
    """(channel, score, status) of (channel, snr_db) and (channel, clarity): 0.6 of the clipped SNR and 0.4 of the speech band's share."""
    both = levels.join(clarity, "channel")
    score = 0.6 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("snr_db") / 20)) + 0.4 * F.col("clarity")
    return both.select("channel", score.alias("score")).withColumn("status", F.when(F.col("score") < least, "warning").otherwise("pass"))
