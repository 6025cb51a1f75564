"""Voices on audio chunks: pitch stability, intelligibility, likeness to synthesis, and the fingerprint of a recording."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.operators import kernels
from tonegrid.operators.events import Chunk, per_chunk
from tonegrid.operators.kernels import kept

#: Bands of modulation in hertz, and frames of the pitch track a second.
WOW, FLUTTER, TRACK_HZ = (0.1, 10.0), (10.0, 200.0), 40.0


def pitch_stability(signals: DataFrame) -> DataFrame:
    """(file_id, drift_cents, wow_db, flutter_db) of files with four voiced frames or more.

    Drift is the range of the track behind a median of five, in cents of its mean. Wow and flutter are shares of the
    modulation spectrum of the voiced frames, put one after the other: a track has 40 numbers a second, so that a
    day of sound is 3.5 million, and is transformed as one row. With less than eight voiced frames both are 0.
    """
    track = kernels.per_frame(signals, kernels.seconds(0.05), kernels.seconds(0.025), kernels.autocorrelated).where(~F.isnan("value"))
    order, whole = Window.partitionBy("file_id").orderBy("frame"), Window.partitionBy("file_id")
    near = [F.coalesce(f, F.lit(0.0)) for f in (F.lag("value", 2).over(order), F.lag("value").over(order), F.col("value"), F.lead("value").over(order), F.lead("value", 2).over(order))]
    cents = lambda v: 1200 * F.log2(v / F.avg("value").over(whole))
    voiced = track.select("file_id", "frame", cents(F.col("value")).alias("cents"), cents(F.array_sort(F.array(*near))[2]).alias("smooth"))
    per = voiced.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), (F.max("smooth") - F.min("smooth")).alias("drift_cents"), F.transform(F.array_sort(F.collect_list(F.struct("frame", "cents"))), lambda s: s["cents"]).alias("cents"))

    @F.pandas_udf("struct<wow_db:double,flutter_db:double>")
    def modulation(tracks):
        import pandas as pd

        out = []
        for x in tracks:
            x = np.asarray(x, np.float64)
            power, hz = np.abs(np.fft.rfft(x - x.mean())) ** 2, np.fft.rfftfreq(len(x), 1 / TRACK_HZ)
            out.append([10 * np.log10(power[(hz >= low) & (hz <= high)].sum() / (power.sum() + 1e-12) + 1e-12) if len(x) >= 8 else 0.0 for low, high in (WOW, FLUTTER)])
        return pd.DataFrame(out, columns=["wow_db", "flutter_db"], dtype="float64")

    return per.where("n >= 4").select("file_id", "drift_cents", modulation("cents").alias("m")).select("file_id", "drift_cents", "m.*")


#: The band of speech in hertz; weights of level and clarity; the ratio that counts as full.
SPEECH, WEIGHTS, FULL_DB = (300.0, 3400.0), (0.6, 0.4), 20.0


def intelligibility(chunks: DataFrame, signals: DataFrame) -> DataFrame:
    """(file_id, score): level of loud against quiet frames of 100 ms, and the share of the speech band in the first spectrum."""
    frame = kernels.seconds(0.1)
    rms = kernels.per_frame(signals, frame, frame, lambda x, rate: np.sqrt((x * x).mean(1))).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    floor = F.greatest(F.col("p")[0], F.lit(1e-8))
    ratio = F.when((F.col("n") >= 2) & (F.col("p")[1] >= floor), 20 * F.log10(F.col("p")[1] / floor)).otherwise(0.0)
    power = kernels.segment_power(chunks, 2048).groupBy("file_id").agg((F.coalesce(F.sum(F.when(F.col("hz").between(*SPEECH), F.col("power"))), F.lit(0.0)) / (F.sum("power") + 1e-12)).alias("clarity"))
    both = power.join(rms, "file_id", "left")
    level = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio / FULL_DB)), F.lit(0.0))
    return both.select("file_id", (WEIGHTS[0] * level + WEIGHTS[1] * F.col("clarity")).alias("score"))


def synthetic_likeness(chunks: DataFrame, signals: DataFrame) -> DataFrame:
    """(file_id, score): regular pitch, coherent phases and a flat band of 4 to 8 kHz; a feature for a person to look at, no verdict."""
    size, hop = 2048, 512

    def turns(c: Chunk) -> dict:
        first = np.arange(-c.start % hop + c.start, c.end, hop)
        first = first[first + hop + size <= c.frames]
        if not len(first):
            return {"bin": []}
        x = c.at(first[0], first[-1] + hop + size)
        total, n = np.zeros(size // 2 + 1, np.complex128), len(first)
        for i in range(0, n, 256):
            part = min(256, n - i)
            view = np.lib.stride_tricks.sliding_window_view(x[i * hop : (i + part) * hop + size], size)[::hop]
            angle = np.angle(np.fft.rfft(view * np.hanning(size), axis=1))
            total += np.exp(1j * np.diff(angle, axis=0)).sum(0)
        return {"bin": np.arange(len(total)), "re": total.real, "im": total.imag, "n": np.full(len(total), n)}

    sums = per_chunk(signals, turns, "bin long, re double, im double, n long").groupBy("file_id", "bin").agg(*[F.sum(c).alias(c) for c in ("re", "im", "n")])
    coherence = sums.groupBy("file_id").agg(F.avg(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")).alias("coherence"))
    track = kernels.per_frame(signals, kernels.seconds(0.05), kernels.seconds(0.025), kernels.autocorrelated).where(~F.isnan("value"))
    pitch = track.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), (F.stddev_pop("value") / F.avg("value")).alias("cv"))
    mag = F.when(F.col("hz").between(4000, 8000), F.sqrt("power") + 1e-12)
    flat = kernels.segment_power(chunks, size).groupBy("file_id").agg((F.exp(F.avg(F.ln(mag))) / F.avg(mag)).alias("flat"))
    both = coherence.join(pitch, "file_id", "left").join(flat, "file_id", "left")
    regular = F.when(F.col("n") >= 8, 1 - F.least(F.lit(1.0), F.col("cv"))).otherwise(0.0)
    score = 0.4 * regular + 0.3 * F.coalesce("coherence", F.lit(0.0)) + 0.3 * F.coalesce("flat", F.lit(0.0))
    return both.select("file_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


#: Frame and hop of a fingerprint, bits a frame, bands of its first frame and their range in hertz.
PRINT, BITS, BANDS, RANGE = (4096, 2048), 32, 12, (60.0, 8000.0)


def fingerprint(signals: DataFrame) -> DataFrame:
    """(file_id, frames, sha256, bands): 32 bits of each frame, which of its evenly spaced bins are over its mean power; SHA-256 of all in order.

    Bits are texts of 0 and 1. A hash is sequential by nature: a file's bits (one number a frame) are read in order by one
    task, streamed, and never joined to one text. ``bands`` are powers of the first frame in 12 bands of equal ratio.
    """
    size, hop = PRINT

    def bits(c: Chunk) -> dict:
        first = np.arange(-c.start % hop + c.start, c.end, hop)
        first = first[first + size <= c.frames]
        out = {"frame": first // hop, "bits": np.empty(len(first), np.int64), "bands": [None] * len(first)}
        for i, at in enumerate(first.tolist()):
            power = np.abs(np.fft.rfft(c.at(at, at + size) * np.hanning(size))) ** 2
            over = (power > power.mean() + 1e-12)[:: len(power) // BITS][:BITS]
            out["bits"][i] = int("".join("01"[b] for b in over.tolist()), 2)
            if at == 0:
                hz = np.fft.rfftfreq(size, 1 / c.rate)
                edges = np.logspace(np.log10(RANGE[0]), np.log10(min(RANGE[1], c.rate / 2)), BANDS + 1)
                out["bands"][i] = [float(power[(hz >= a) & (hz < b)].sum()) for a, b in zip(edges, edges[1:], strict=False)]
        return out | {"bands": pa.array(out["bands"], pa.list_(pa.float64()))}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, digest, n = None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([of]), pa.array([n]), pa.array([digest.hexdigest()])], ["file_id", "frames", "sha256"])

        for batch in batches:
            for file, value in zip(batch["file_id"].to_pylist(), batch["bits"].to_pylist(), strict=True):
                if file != of:
                    if of is not None:
                        yield done()
                    of, digest, n = file, hashlib.sha256(), 0
                digest.update(f"{value:0{BITS}b}".encode())
                n += 1
        if of is not None:
            yield done()

    found = kept(per_chunk(signals, bits, "frame long, bits long, bands array<double>"))
    ordered = found.select("file_id", "frame", "bits").repartition("file_id").sortWithinPartitions("file_id", "frame")
    digests = ordered.select("file_id", "bits").mapInArrow(hashed, "file_id string, frames long, sha256 string")
    return digests.join(found.where("frame = 0").select("file_id", "bands"), "file_id")
