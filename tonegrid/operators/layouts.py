"""Channels against each other, the low-frequency channel, and the phase of mains hum, on audio chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.operators.events import Chunk, beside, per_chunk
from tonegrid.operators.kernels import mapped
from tonegrid.sources.wav import channels_of

#: Place of the low-frequency channel in layouts of six and eight channels, its highest frequency, and the frame that is judged.
LFE, LFE_HZ, LFE_FRAME = 3, 120.0, 2048
#: The band of mains hum in hertz, the samples its frequency is sought in, frame and hop of its phase in milliseconds.
HUM_HZ, HUM_FRAME, PHASE_MS = (45.0, 65.0), 65_536, (1000, 500)


def channel_moments(chunks: DataFrame) -> DataFrame:
    """(file_id, a, b, n, sa, sb, saa, sbb, sab) of each pair of channels a <= b.

    The channels of one chunk meet in a row, samples without what surrounds them: bounded by the chunk times
    the channels. Sums are then by file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = batch["sides"][row].values
                lists = sides.field("samples")
                x = np.stack([lists[i].values.to_numpy(zero_copy_only=False).astype(np.float64) for i in np.argsort(sides.field("channel").to_numpy())])
                sums, products = x.sum(1), x @ x.T
                a, b = np.triu_indices(len(x))
                keys = batch["file_id"].take(pa.array(np.full(len(a), row)))
                columns = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(np.full(len(a), x.shape[1]), pa.int64()), *(pa.array(v) for v in (sums[a], sums[b], products[a, a], products[b, b], products[a, b]))]
                yield pa.RecordBatch.from_arrays([keys, *columns], ["file_id", "a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])

    rows = channels_of(chunks).groupBy("file_id", "start").agg(F.collect_list(F.struct("channel", "samples")).alias("sides"))
    per = mapped(rows.select("file_id", "sides"), run, "file_id string, a int, b int, n long, sa double, sb double, saa double, sbb double, sab double")
    return per.groupBy("file_id", "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])


def most_alike(moments: DataFrame) -> DataFrame:
    """(file_id, value, a, b): the greatest correlation of two channels, by size; the first such pair, and channels 0 and 0 if none varies with another."""
    spread = lambda s, ss: F.greatest(F.lit(0.0), F.col(ss) / F.col("n") - (F.col(s) / F.col("n")) ** 2)
    va, vb = spread("sa", "saa"), spread("sb", "sbb")
    together = F.col("sab") / F.col("n") - F.col("sa") / F.col("n") * F.col("sb") / F.col("n")
    size = F.when((F.sqrt(va) > 1e-12) & (F.sqrt(vb) > 1e-12), F.least(F.lit(1.0), F.abs(F.try_divide(together, F.sqrt(va * vb))))).otherwise(0.0)
    best = moments.where("a < b").withColumn("value", size).groupBy("file_id").agg(F.max(F.struct("value", -F.col("a"), -F.col("b"))).alias("best"))
    place = lambda n: F.when(F.col("best.value") > 0, -F.col("best")[n]).otherwise(0)
    return best.select("file_id", F.col("best.value").alias("value"), place("col2").alias("a"), place("col3").alias("b"))


def low_share(chunks: DataFrame) -> DataFrame:
    """(file_id, low_pct): the share of a file's first frame of its low-frequency channel that lies under ``LFE_HZ``; 100 where it is too short to tell, 0 where it is silent."""

    def kernel(c: Chunk) -> dict:
        n, share = min(LFE_FRAME, c.frames), 100.0
        if n >= 256:
            power = np.abs(np.fft.rfft(c.at(0, n) * np.hanning(n))) ** 2
            share = 100.0 * float(power[np.fft.rfftfreq(n, 1 / c.rate) <= LFE_HZ].sum() / power.sum()) if power.sum() > 0 else 0.0
        return {"low_pct": [share]}

    return per_chunk(chunks.where((F.col("channel") == LFE) & (F.col("start") == 0)), kernel, "low_pct double").select("file_id", "low_pct")


def root_mean(squares: Column, n: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), squares) / n)


def hum(signals: DataFrame) -> DataFrame:
    """(file_id, hz, snr_db): the strongest frequency of the mains band at the beginning of each file, over the band's median."""

    def kernel(c: Chunk) -> dict:
        n = min(c.frames, HUM_FRAME)
        if c.frames < c.rate or n < 2048:
            return {"hz": [0.0], "snr_db": [0.0]}
        power, hz = np.abs(np.fft.rfft(c.at(0, n) * np.hanning(n))) ** 2, np.fft.rfftfreq(n, 1 / c.rate)
        band = (hz >= HUM_HZ[0]) & (hz <= HUM_HZ[1])
        if not band.any():
            return {"hz": [0.0], "snr_db": [0.0]}
        floor, at = float(np.median(power[band])), int(power[band].argmax())
        return {"hz": [float(hz[band][at])], "snr_db": [10 * float(np.log10(power[band][at] / floor)) if floor > 0 else 0.0]}

    return per_chunk(signals.where("start = 0"), kernel, "hz double, snr_db double").select("file_id", "hz", "snr_db")


def phase_jumps(signals: DataFrame, found: DataFrame, most_rad: float) -> DataFrame:
    """(file_id, jumps): how often the phase at a file's hum, ``found`` by :func:`hum`, moves by more than ``most_rad`` from one frame to the next.

    One row a frame, two a second, is put in order by file; samples stay where they are.
    """

    def kernel(c: Chunk) -> dict:
        size, hop = (c.rate * ms // 1000 for ms in PHASE_MS)
        first = np.arange(-(-c.start // hop), -(-c.end // hop)) if hop > 0 else np.empty(0, np.int64)
        first = first[first * hop + size <= c.frames]
        if size < 4 or c.more["hz"] <= 0 or not len(first):
            return {"frame": [], "phase": []}
        tone = np.exp(-2j * np.pi * c.more["hz"] * np.arange(size) / c.rate)
        view = np.lib.stride_tricks.sliding_window_view(c.at(int(first[0]) * hop, int(first[-1]) * hop + size), size)
        return {"frame": first, "phase": np.angle(view[::hop] @ tone)}

    phases = per_chunk(beside(signals, found.select("file_id", "hz")), kernel, "frame long, phase double", "hz")
    step = F.col("phase") - F.lag("phase").over(Window.partitionBy("file_id").orderBy("frame"))
    turned = phases.select("file_id", (F.pmod(step + np.pi, F.lit(2 * np.pi)) - np.pi).alias("step"))
    return turned.groupBy("file_id").agg(F.count_if(F.abs("step") > most_rad).alias("jumps"))
