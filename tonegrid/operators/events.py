"""Events on audio chunks: clicks, dropouts, repetitions and onsets, whatever the chunks.

A kernel finds runs in its chunk; runs that touch a border are joined to their neighbours in Spark. Where
events exclude each other (the next one begins a step after the last at the earliest), the choice is sequential
in a file: one row for each run, not the samples, is then read in order with the place of the next choice carried along.

Thresholds that are percentiles of all samples of a file are exact: one pass counts values by the upper bits
of their representation, which keep their order; the second fetches those in the bin of the rank alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.operators.kernels import floats, kept, mapped

#: Files whose small rows are broadcast beside their chunks; for more of them chunks are shuffled.
MANY_FILES = 250_000


class Chunk:
    """One chunk with its halos, addressed by frames of the file; frames outside of the file are zeros."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.rate, self.start, self.frames = (batch[c][row].as_py() for c in ("sample_rate", "start", "frames"))
        left, samples, right = (floats(batch, c, row) for c in ("left", "samples", "right"))
        self.size, self.low = len(samples), self.start - len(left)
        self.end, self.x = self.start + self.size, np.concatenate((left, samples, right))
        self.more = {c: batch[c][row].as_py() for c in batch.schema.names if c not in ("file_id", "channel", "sample_rate", "start", "frames", "left", "samples", "right")}

    def at(self, low: int, high: int) -> np.ndarray:
        a, b = max(low, 0), max(min(high, self.frames), max(low, 0))
        if b > a and (a < self.low or b > self.low + len(self.x)):
            raise ValueError(f"frames {a} to {b} aren't all among those that come with the chunk at {self.start}: scan with longer halos")
        return np.concatenate((np.zeros(min(high, 0) - min(low, 0)), self.x[a - self.low : b - self.low], np.zeros(max(high - low, 0) - (min(high, 0) - min(low, 0)) - (b - a))))


def per_chunk(chunks: DataFrame, kernel: Callable[[Chunk], dict], schema: str, *more: str) -> DataFrame:
    """(file_id, channel, ...): what ``kernel`` gives for each chunk, arrays by column."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = kernel(Chunk(batch, row))
                n = len(found[columns[0]])
                if n:
                    keys = [batch[c].take(pa.array(np.full(n, row))) for c in ("file_id", "channel")]
                    yield pa.RecordBatch.from_arrays([*keys, *(v if isinstance(v, pa.Array) else pa.array(v) for v in (found[c] for c in columns))], ["file_id", "channel", *columns])

    return mapped(chunks.select("file_id", "channel", "sample_rate", "frames", "start", "left", "samples", "right", *more), run, f"file_id string, channel int, {schema}")


def beside(chunks: DataFrame, small: DataFrame, *keys: str) -> DataFrame:
    """``chunks`` with what ``small`` says of their file (or channel): broadcast if it has few rows, else both are shuffled."""
    keys = keys or ("file_id",)
    small = kept(small)
    return chunks.join(F.broadcast(small) if small.count() <= MANY_FILES else small, list(keys))


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def joined_runs(pieces: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end, before, inside, after) of whole runs from pieces (keys, start, end, before, inside, after, open).

    ``open`` pieces touch a border of their chunk, at most two of each; only these are put in order.
    """
    order = Window.partitionBy(*keys).orderBy("start")
    edges = pieces.where("open").withColumn("new", F.when(F.col("start") > F.coalesce(F.lag("end").over(order), F.lit(-1)), 1).otherwise(0))
    edges = edges.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = edges.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("before", "start").alias("before"), F.sum("inside").alias("inside"), F.max_by("after", "start").alias("after"))
    columns = [*keys, "start", "end", "before", "inside", "after"]
    return pieces.where("NOT open").select(*columns).union(whole.select(*columns))


def clicks(channels: DataFrame, sensitivity: float) -> DataFrame:
    """(file_id, channel, start, end): runs of second differences over so many times their root mean square in the channel."""

    def second(c: Chunk) -> np.ndarray:
        return np.diff(c.at(c.start, max(min(c.end, c.frames - 2), c.start) + 2), 2) if c.frames > 2 else np.empty(0)

    def squares(c: Chunk) -> dict:
        d = second(c)
        return {"squares": [float(d @ d)], "n": [len(d)]}

    def over(c: Chunk) -> dict:
        start, end = runs_of(np.abs(second(c)) > sensitivity * c.more["level"])
        none = np.zeros(len(start))
        return {"start": start + c.start, "end": end + c.start, "before": none, "inside": none, "after": none, "open": (start == 0) | (end == c.size)}

    level = per_chunk(channels, squares, "squares double, n long").groupBy("file_id", "channel").agg((F.sqrt(F.sum("squares") / F.sum("n")) + 1e-12).alias("level")).where("level IS NOT NULL")
    found = per_chunk(beside(channels, level, "file_id", "channel"), over, "start long, end long, before double, inside double, after double, open boolean", "level")
    return joined_runs(found, "file_id", "channel").select("file_id", "channel", "start", "end")


def dropouts(channels: DataFrame, threshold: float, least_ms: float) -> DataFrame:
    """(file_id, channel, start, end): near-silent runs of some length whose neighbourhood, four times as long to either side, is ten times louder than the threshold."""

    def quiet(c: Chunk) -> dict:
        x, m = c.at(c.start, c.end), max(1, int(c.rate * least_ms / 1000))
        start, end = runs_of(np.abs(x) < threshold)
        border = (start == 0) | (end == c.size)
        keep = (end - start >= m) | border
        start, end, border = start[keep], end[keep], border[keep]
        low, high = max(0, c.start - 4 * m), min(c.frames, c.end + 4 * m)
        sums = np.concatenate(([0.0], np.cumsum(c.at(low, high) ** 2)))
        energy = lambda a, b: sums[np.clip(b, low, high) - low] - sums[np.clip(a, low, high) - low]
        s, e = start + c.start, end + c.start
        return {"start": s, "end": e, "before": energy(s - 4 * m, s), "inside": energy(s, e), "after": energy(e, e + 4 * m), "open": border, "least": np.full(len(s), m), "frames": np.full(len(s), c.frames)}

    found = per_chunk(channels, quiet, "start long, end long, before double, inside double, after double, open boolean, least long, frames long")
    whole = joined_runs(found, "file_id", "channel", "least", "frames")
    low, high = F.greatest(F.lit(0), F.col("start") - 4 * F.col("least")), F.least(F.col("frames"), F.col("end") + 4 * F.col("least"))
    loud = F.sqrt((F.col("before") + F.col("inside") + F.col("after")) / (high - low)) >= 10 * threshold
    return whole.where((F.col("end") - F.col("start") >= F.col("least")) & (high - low > F.col("end") - F.col("start")) & loud).select("file_id", "channel", "start", "end")


def greedy(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, step, first, n) of runs (keys, step, start, end) of places: the first place of all, then always the first one a ``step`` or more after the last.

    Chosen in a run are ``first``, ``first + step``, ... ``n`` times. Runs of one key are read in order by one task, streamed.
    """
    names = [*keys, "step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, free = None, 0
        for batch in batches:
            out: list = []
            for row, key, start, end in zip(range(batch.num_rows), zip(*(batch[k].to_pylist() for k in names), strict=True), batch["start"].to_pylist(), batch["end"].to_pylist(), strict=True):
                if key != of:
                    of, free = key, start
                first = max(start, free)
                if first < end:
                    n = -(-(end - first) // key[-1])
                    out.append((row, first, n))
                    free = first + n * key[-1]
            took = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[k].take(took) for k in names), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], [*names, "first", "n"])

    kinds = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in names)
    ordered = runs.select(*names, "start", "end").repartition(*names).sortWithinPartitions(*names, "start")
    return ordered.mapInArrow(run, f"{kinds}, first long, n long")


def repetitions(channels: DataFrame, least: int, most: int = 4096, near: float = 1e-6) -> DataFrame:
    """(file_id, channel, step, first, n): blocks of ``step`` / 2 samples that are repeated at once, none of them overlapping one of its length.

    Lengths double from ``least`` on, to ``most`` or half of the file.
    """

    def repeated(c: Chunk) -> dict:
        found, size = [], least
        while size <= min(most, c.frames // 2):
            end = min(c.end, c.frames - 2 * size + 1)
            if end > c.start:
                x = c.at(c.start, end + 2 * size - 1)
                equal = np.concatenate(([0], np.cumsum(np.abs(x[:-size] - x[size:]) < near)))
                s, e = runs_of(equal[size:] - equal[:-size] == size)
                found.append((np.full(len(s), 2 * size), s + c.start, e + c.start))
            size *= 2
        columns = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3)]
        return dict(zip(("step", "start", "end"), columns, strict=True))

    return greedy(per_chunk(channels, repeated, "step long, start long, end long"), "file_id", "channel")


#: Bits of a double's representation below those by which values are counted.
BELOW = 46


def _rank(values: np.ndarray) -> np.ndarray:
    """The upper bits of doubles as integers of the same order."""
    bits = (values + 0.0).view(np.int64)  # one zero
    return (bits ^ (bits >> 63 & 0x7FFFFFFFFFFFFFFF)) >> BELOW


def file_percentile(chunks: DataFrame, values: Callable[[Chunk], np.ndarray], share: float, *more: str) -> DataFrame:
    """(file_id, level): the exact percentile, linear between ranks, of all values of a file's chunks; ``more`` are columns that ``values`` needs."""

    def counted(c: Chunk) -> dict:
        bins, n = np.unique(_rank(values(c)), return_counts=True)
        return {"bin": bins, "n": n}

    def within(c: Chunk) -> dict:
        v = values(c)
        bins = _rank(v)
        v, n = np.unique(v[(bins >= c.more["low_bin"]) & (bins <= c.more["high_bin"])], return_counts=True)
        return {"value": v, "n": n}

    of_file = Window.partitionBy("file_id")
    upto = of_file.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    place = share * (F.sum("n").over(of_file) - 1)
    bins = per_chunk(chunks, counted, "bin long, n long", *more).groupBy("file_id", "bin").agg(F.sum("n").alias("n"))
    bins = bins.select("file_id", "bin", "n", place.alias("place"), F.sum("n").over(upto).alias("upto"))
    holds = (F.col("upto") > F.floor("place")) & (F.col("upto") - F.col("n") <= F.ceil("place"))
    asked = bins.where(holds).groupBy("file_id").agg(F.min("bin").alias("low_bin"), F.max("bin").alias("high_bin"), F.min(F.col("upto") - F.col("n")).alias("below"), F.first("place").alias("place"))
    near = per_chunk(beside(chunks, asked), within, "value double, n long", "low_bin", "high_bin", *more).groupBy("file_id", "value").agg(F.sum("n").alias("n"))
    near = near.join(asked, "file_id").withColumn("upto", F.col("below") + F.sum("n").over(of_file.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    ends = near.groupBy("file_id").agg(at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"), F.first(F.col("place") - F.floor("place")).alias("t"))
    step = F.col("b") - F.col("a")
    return ends.select("file_id", F.when(F.col("t") < 0.5, F.col("a") + step * F.col("t")).otherwise(F.col("b") - step * (1 - F.col("t"))).alias("level"))


#: Samples of an envelope's mean; milliseconds between onsets, and looked back from one; onsets that are measured.
ENVELOPE, APART_MS, BACK_MS, MEASURED = 64, 200.0, 5.0, 20


def envelope(c: Chunk, low: int, high: int) -> np.ndarray:
    """Mean magnitude around the frames ``low`` to ``high``."""
    x = np.abs(c.at(low - ENVELOPE // 2, high + ENVELOPE // 2 - 1))
    return np.convolve(x, np.ones(ENVELOPE) / ENVELOPE, "valid") if len(x) >= ENVELOPE else np.empty(0)


def onset_attacks(signals: DataFrame) -> DataFrame:
    """(file_id, onsets, worst, mean): rises of the envelope over their 99th percentile, and the time from 10 to 90 % of the peak for the first of them, in ms."""

    def rises(c: Chunk) -> np.ndarray:
        return np.diff(envelope(c, c.start, min(c.end, c.frames - 1) + 1))

    def over(c: Chunk) -> dict:
        start, end = runs_of(rises(c) > c.more["level"])
        return {"step": np.full(len(start), int(c.rate * APART_MS / 1000)), "start": start + c.start, "end": end + c.start}

    def attacks(c: Chunk) -> dict:
        back, out = int(c.rate * BACK_MS / 1000), []
        for at in (p for p in c.more["first"] if c.start <= p < c.end):
            part = envelope(c, max(0, at - back), min(c.frames, at + 4 * back))
            peak = part.max(initial=0.0)
            if len(part) >= 4 and peak > 0:
                out.append(1000.0 * ((part > 0.9 * peak).argmax() - (part > 0.1 * peak).argmax()) / c.rate)
        return {"attack": np.array(out, np.float64)}

    candidates = per_chunk(beside(signals, file_percentile(signals, rises, 0.99)), over, "step long, start long, end long", "level")
    chosen = greedy(candidates, "file_id").select("file_id", F.explode(F.sequence(F.col("first"), F.col("first") + (F.col("n") - 1) * F.col("step"), F.col("step"))).alias("at"))
    nth = chosen.withColumn("nth", F.row_number().over(Window.partitionBy("file_id").orderBy("at")))
    onsets = nth.groupBy("file_id").agg(F.count(F.lit(1)).alias("onsets"), F.collect_list(F.when(F.col("nth") <= MEASURED, F.col("at"))).alias("first"))
    measured = per_chunk(beside(signals, onsets), attacks, "attack double", "first").where("attack > 0")
    return onsets.select("file_id", "onsets").join(measured.groupBy("file_id").agg(F.max("attack").alias("worst"), F.avg("attack").alias("mean")), "file_id", "left")


def decay_time(signals: DataFrame) -> DataFrame:
    """(file_id, rt60): seconds in which the backward-integrated energy falls by 60 dB, by the line through its first 30; 0 where there is none, 10 at most."""

    def energy(c: Chunk) -> dict:
        x = c.at(c.start, c.end)
        return {"start": [c.start], "energy": [float(x @ x)]}

    def line(c: Chunk) -> dict:
        x = c.at(c.start, c.end)
        left = (np.cumsum((x * x)[::-1])[::-1] + c.more["later"]) / c.more["total"]
        level = 10 * np.log10(left + 1e-12)
        t, level = (np.arange(c.start, c.end) / c.rate)[level >= -30], level[level >= -30]
        return {k: [float(v)] for k, v in (("n", len(t)), ("t", t.sum()), ("l", level.sum()), ("tt", t @ t), ("tl", t @ level))}

    of_file = Window.partitionBy("file_id")
    later = per_chunk(signals, energy, "start long, energy double").withColumns({
        "later": F.coalesce(F.sum("energy").over(of_file.orderBy(F.col("start").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "total": F.sum("energy").over(of_file),
    })
    sums = per_chunk(beside(signals, later.where("total > 0").select("file_id", "start", "later", "total"), "file_id", "start"), line, "n double, t double, l double, tt double, tl double", "later", "total")
    sums = sums.groupBy("file_id").agg(*[F.sum(c).alias(c) for c in ("n", "t", "l", "tt", "tl")])
    slope = F.try_divide(F.col("n") * F.col("tl") - F.col("t") * F.col("l"), F.col("n") * F.col("tt") - F.col("t") * F.col("t"))
    return sums.select("file_id", F.when((F.col("n") >= 4) & (slope < -1.0), F.least(F.lit(10.0), -60.0 / slope)).otherwise(0.0).alias("rt60"))
