"""WAV scan: files to chunk rows (file_id, channel, channels, sample_rate, frames, start, samples, left, right).

``binaryFile`` deals the files to tasks; a small parser cuts each into chunks of ``CHUNK`` frames per
channel, with the samples to either side that filters and blocks reach into, while the whole file is at
hand; so what follows is a map over chunks however long a file is, and no samples are shuffled. Files of
several channels also have their mean as channel ``MIX``. Unreadable files become one row with an error
(files without bytes are not listed by Spark).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonegrid.sources.formats import AudioError, layout, samples

CHUNK = 1 << 17
#: Seconds after a chunk that come with it (the longest block of any analyzer), and frames before it (what a filter remembers).
AFTER_S, BEFORE = 3.0, 1 << 16
MIX = -1
SCHEMA = "file_id string, source_path string, file_sha256 string, channel int, channels int, sample_rate int, frames long, bit_depth int, start long, samples array<float>, left array<float>, right array<float>, error string"
#: Suffixes that are audio at all; those this scan reads.
SUFFIXES = (".wav", ".flac", ".mp3", ".ogg", ".aiff", ".aif")
READABLE = (".wav",)


WavError = AudioError


def parse(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(sample rate, bit depth, float32 samples by channel) of a whole file."""
    of = layout(lambda at, n: raw[at : at + n], len(raw))
    return of.rate, of.depth, samples(raw[of.data : of.data + of.frames * of.width], of)


def encode(x: np.ndarray, rate: int) -> bytes:
    """A 16-bit PCM WAV of float samples by channel: 32-bit fixed point, saturated, then its upper half."""
    fixed = np.clip(np.rint(np.atleast_2d(x).astype(np.float32).astype(np.float64) * 2**31), -(2**31), 2**31 - 1).astype(np.int64) >> 16
    data = fixed.T.astype("<i2").tobytes()
    channels = np.atleast_2d(x).shape[0]
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(data))
    return head + data


def _decoder(after_s: float):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, sha in zip(batch["path"], batch["content"], batch["sha"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    if not name.lower().endswith(SUFFIXES):
                        raise WavError("unsupported file type")
                    if not name.lower().endswith(READABLE):
                        raise WavError("no decoder for this file type")
                    rate, depth, x = parse(content)
                except WavError as error:
                    yield pd.DataFrame([(sha, path, sha, *[None] * 9, str(error))], columns=columns)
                    continue
                signals = dict(enumerate(x)) if len(x) == 1 else {**dict(enumerate(x)), MIX: x.mean(0, dtype=np.float32)}
                after = int(np.ceil(rate * after_s)) + 1
                for start in range(0, x.shape[1], CHUNK):
                    end = start + CHUNK
                    rows = [
                        (sha, path, sha, c, x.shape[0], rate, x.shape[1], depth, start, v[start:end], v[max(0, start - BEFORE) : start], v[end : end + after], None)
                        for c, v in signals.items()
                    ]
                    yield pd.DataFrame(rows, columns=columns)

    return decode


def read_audio(spark: SparkSession, path: str, glob: str = "*", after_s: float = AFTER_S) -> DataFrame:
    """Chunk rows of all files under ``path`` that match ``glob``; a file is known by its SHA-256. Each file is decoded in one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("sha")).mapInPandas(_decoder(after_s), SCHEMA)


def mono(chunks: DataFrame) -> DataFrame:
    """One signal of each file: its only channel, or the mean of all."""
    return chunks.where((F.col("channels") == 1) | (F.col("channel") == MIX))


def channels_of(chunks: DataFrame) -> DataFrame:
    """The channels of each file, without their mean."""
    return chunks.where(F.col("channel") != MIX)


def chunks_of(signal: DataFrame, sample_rate: int, chunk: int = CHUNK, before: int | None = None, after: int | None = None) -> DataFrame:
    """Chunk rows of a long signal (channel, frame, x), each channel a mono file; halos are those of a scan at this rate."""
    before, after = BEFORE if before is None else before, int(np.ceil(sample_rate * AFTER_S)) + 1 if after is None else after
    number = F.floor(F.col("frame") / chunk)
    per = signal.groupBy("channel", number.alias("n")).agg(F.array_sort(F.collect_list(F.struct("frame", "x"))).alias("s"))
    counts = signal.groupBy(F.col("channel").alias("of")).agg(F.count(F.lit(1)).alias("frames"))
    rows = per.join(counts, F.col("channel") == F.col("of")).select(
        F.col("channel").cast("string").alias("file_id"), F.lit(0).alias("channel"), F.lit(1).alias("channels"), F.lit(sample_rate).alias("sample_rate"),
        "frames", (F.col("n") * chunk).alias("start"), F.transform("s", lambda x: x["x"].cast("float")).alias("samples"),
    )
    w = Window.partitionBy("file_id", "channel").orderBy("start")
    near = lambda a, b: F.flatten(F.collect_list("samples").over(w.rowsBetween(a, b)))
    left, right = near(-(-(-before // chunk)), -1), near(1, -(-after // chunk))
    return rows.withColumns({"left": F.slice(left, F.greatest(F.lit(1), F.size(left) - before + 1), F.lit(before)) if before else F.slice("samples", 1, 0), "right": F.slice(right, 1, after) if after else F.slice("samples", 1, 0)})


def subjects(chunks: DataFrame) -> DataFrame:
    """One row per file: what a bundle says of its subject."""
    layout = F.expr("CASE channels WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE concat('custom-', channels, 'ch') END")
    per = chunks.where(F.coalesce("channel", F.lit(0)) >= 0).groupBy("file_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("source_path", "file_sha256", "channels", "sample_rate", "frames", "bit_depth", "error")])
    return per.withColumn("channel_layout", F.when(F.col("channels").isNotNull(), layout)).withColumn("duration_s", F.try_divide(F.col("frames"), F.col("sample_rate")))
