"""Envelopes of audio by the analytic signal, from chunks.

The analytic signal of a whole file is a circular convolution of all its samples. Here its kernel is cut to
``REACH`` samples to either side and tapered, so that a chunk needs no more than its halos; chunks at the ends
of a file get its other end, as the whole transform wraps around. What is lost are frequencies of a few hertz.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.operators.events import Chunk, beside, file_percentile, per_chunk
from tonegrid.operators.kernels import butterworth

REACH = 1 << 15


@lru_cache
def _transformer(n: int) -> np.ndarray:
    """Spectrum of the tapered Hilbert kernel, centred at sample ``REACH``."""
    k = np.arange(-REACH, REACH + 1)
    ideal = np.where(k % 2, 2 / (np.pi * np.where(k == 0, 1, k)), 0.0)
    return np.fft.rfft(ideal * (0.5 + 0.5 * np.cos(np.pi * k / (REACH + 1))), n)


def wrapped(signals: DataFrame) -> DataFrame:
    """``signals`` with ``head`` and ``tail``, the first and the last ``REACH`` samples of the file, where a chunk is that near to an end.

    A chunk that is a whole file has both already; others at the ends are joined to each other. No other chunk moves.
    """
    size, none = F.size("samples"), F.slice("samples", 1, 0)
    first, last = F.col("start") == 0, F.col("start") + size >= F.col("frames")
    near = first | (F.col("start") < REACH) | (F.col("start") + size + REACH > F.col("frames"))
    whole = signals.where(first & last).withColumns({"head": F.slice("samples", 1, REACH), "tail": F.slice("samples", F.greatest(F.lit(1), size - REACH + 1), REACH)})
    inner = signals.where(~near).withColumns({"head": none, "tail": none})
    edges = signals.where(near & ~(first & last))
    ahead = F.concat(F.slice("samples", 1, REACH), F.slice("right", 1, REACH))
    behind = F.concat("left", "samples")
    heads = signals.where(first & ~last).select("file_id", F.slice(ahead, 1, REACH).alias("head"))
    tails = signals.where(last & ~first).select("file_id", F.slice(behind, F.greatest(F.lit(1), F.size(behind) - REACH + 1), REACH).alias("tail"))
    return whole.unionByName(inner).unionByName(edges.join(heads.join(tails, "file_id"), "file_id").select(*inner.columns))


def analytic_envelope(c: Chunk, low: int, high: int) -> np.ndarray:
    """Magnitude of the analytic signal at the frames ``low`` to ``high`` of a :func:`wrapped` chunk."""
    begin, end = low - REACH, high + REACH
    x = c.at(begin, end)
    if begin < 0 and len(c.more["tail"]):
        tail = np.asarray(c.more["tail"], np.float64)
        n = min(-begin, len(tail))
        x[-begin - n : -begin] = tail[len(tail) - n :]
    if end > c.frames and len(c.more["head"]):
        head = np.asarray(c.more["head"], np.float64)
        n = min(end - c.frames, len(head))
        x[c.frames - begin : c.frames - begin + n] = head[:n]
    size = 1 << int(np.ceil(np.log2(len(x) + 2 * REACH)))
    y = np.fft.irfft(np.fft.rfft(x, size) * _transformer(size), size)[2 * REACH : 2 * REACH + high - low]
    return np.hypot(x[REACH : REACH + high - low], y)


def grid_alignment(signals: DataFrame) -> DataFrame:
    """(file_id, onsets, value): 1 less the variation of the intervals between steep rises of the envelope, 0 at least."""
    signals = wrapped(signals)
    more = ("head", "tail")

    def steps(c: Chunk, extra: int = 0) -> np.ndarray:
        return np.diff(analytic_envelope(c, c.start, min(c.end + extra, c.frames - 1) + 1))

    def positive(c: Chunk) -> np.ndarray:
        d = steps(c)
        return d[d > 0]

    def intervals(c: Chunk) -> dict:
        above = steps(c, 1) > c.more["level"]
        at = np.flatnonzero(~above[:-1] & above[1:]) + c.start
        between = np.diff(at).astype(np.float64)
        return {k: [v] for k, v in (("first", int(at[0])), ("last", int(at[-1])), ("n", len(at)), ("s", float(between.sum())), ("ss", float(between @ between)))} if len(at) else {"first": []}

    level = file_percentile(signals, positive, 0.99, *more)
    per = per_chunk(beside(signals, level), intervals, "first long, last long, n long, s double, ss double", *more, "level")
    gap = (F.col("first") - F.lag("last").over(Window.partitionBy("file_id").orderBy("first"))).cast("double")
    per = per.withColumn("gap", F.coalesce(gap, F.lit(0.0))).groupBy("file_id").agg(F.sum("n").alias("onsets"), F.sum(F.col("s") + F.col("gap")).alias("s"), F.sum(F.col("ss") + F.col("gap") * F.col("gap")).alias("ss"))
    mean = F.col("s") / (F.col("onsets") - 1)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / (F.col("onsets") - 1) - mean * mean))
    return per.where("onsets >= 4").select("file_id", "onsets", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - spread / (mean + 1e-12))).alias("value"))


#: The band of syllables in hertz, and the share of the highest peak that counts.
SYLLABLES, PEAK_SHARE = (2.0, 7.0), 0.3
#: Rate of the envelope whose syllables are counted, and seconds after which its filter has forgotten.
ENVELOPE_HZ, FORGOTTEN_S = 200, 20


def syllable_rate(signals: DataFrame) -> DataFrame:
    """(file_id, value): how often a second the envelope's fluctuation at 2 to 7 Hz rises over a share of its peak.

    The envelope is averaged to some 200 Hz before it is filtered: from there on a chunk is a few hundred numbers,
    and those of its predecessors that the filter remembers come with it by a window.
    """

    def averaged(c: Chunk) -> dict:
        import pyarrow as pa

        block = max(1, c.rate // ENVELOPE_HZ)
        first, last = -(-c.start // block), min(-(-c.end // block), c.frames // block)
        if last <= first:
            return {"start": []}
        e = analytic_envelope(c, first * block, last * block).reshape(-1, block).mean(1)
        return {"start": [first], "seconds": [c.frames / c.rate], "hz": [c.rate / block], "e": pa.array([e.tolist()])}

    per = per_chunk(wrapped(signals), averaged, "start long, seconds double, hz double, e array<double>", "head", "tail")
    order = Window.partitionBy("file_id").orderBy("start")
    memory = FORGOTTEN_S * ENVELOPE_HZ * 2
    earlier = F.flatten(F.collect_list("e").over(order.rangeBetween(-memory, -1)))

    @F.pandas_udf("array<double>")
    def filtered(earlier, e, hz):
        import pandas as pd

        out = []
        for before, now, rate in zip(earlier, e, hz, strict=True):
            x = np.concatenate((np.asarray(before, np.float64), np.asarray(now, np.float64)))
            n = 1 << int(np.ceil(np.log2(len(x) + FORGOTTEN_S * rate)))
            out.append(np.fft.irfft(np.fft.rfft(x, n) * butterworth(*SYLLABLES, rate, n), n)[len(before) : len(x)])
        return pd.Series(out)

    y = per.withColumn("y", filtered(earlier, "e", "hz"))
    top = PEAK_SHARE * F.max(F.array_max(F.transform("y", lambda v: F.abs(v)))).over(Window.partitionBy("file_id"))
    y = y.withColumns({"level": top, "previous": F.coalesce(F.lag(F.element_at("y", -1)).over(order), F.element_at("y", 1))})
    rising = F.zip_with("y", F.slice(F.concat(F.array("previous"), "y"), 1, F.size("y")), lambda a, b: (F.abs(a) > F.col("level")) & ~(F.abs(b) > F.col("level")))
    return y.groupBy("file_id").agg((F.sum(F.when(F.col("level") > 0, F.size(F.filter(rising, lambda r: r))).otherwise(0)) / F.first("seconds")).alias("value"))
