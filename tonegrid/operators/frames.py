"""Short-time spectra as tables: one row a frame, for DataFrames and, as a table function, for SQL.

A frame belongs to the chunk in which it begins; what it reaches into comes with the chunk, so that rows are the same
whatever the chunks, and nothing is carried from one to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.operators.kernels import KEY_SCHEMA, KEYS, floats, keyed, mapped, periodic_hann, starts_in


def magnitudes(x: np.ndarray, first: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, magnitude spectra) of the frames that begin at ``first``, some hundred at a time."""
    view = np.lib.stride_tricks.sliding_window_view(x, size) if len(first) else None
    for i in range(0, len(first), 256):
        yield first[i : i + 256], np.abs(np.fft.rfft(view[first[i : i + 256]] * periodic_hann(size), axis=1)).astype(np.float32)


def stft(chunks: DataFrame, size: int = 1024, hop: int = 256) -> DataFrame:
    """(file_id, channel, channels, sample_rate, frames, frame, mag): magnitudes of Hann-windowed frames of every signal given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, frames = batch["start"][row].as_py(), batch["frames"][row].as_py()
                x, ahead = floats(batch, "samples", row), floats(batch, "right", row)
                for at, mag in magnitudes(np.concatenate((x, ahead)), starts_in(start, len(x), len(ahead), frames, size, hop), size):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * mag.shape[1]), pa.array(mag.ravel()))
                    yield pa.RecordBatch.from_arrays([*keyed(batch, row, len(at)), pa.array((at + start) // hop), lists], [*KEYS, "frame", "mag"])

    return mapped(chunks.select(*KEYS, "start", "samples", "right"), run, f"{KEY_SCHEMA}, frame long, mag array<float>")


class Stft:
    """``stft(samples, right, start, frames, size, hop)`` of one chunk: rows (frame, mag)."""

    def eval(self, samples, right, start: int, frames: int, size: int, hop: int):
        x = np.concatenate((np.asarray(samples, np.float64), np.asarray(right, np.float64)))
        for at, mag in magnitudes(x, starts_in(start, len(samples), len(right), frames, size, hop), size):
            yield from zip(((at + start) // hop).tolist(), mag.tolist(), strict=True)


def register(spark: SparkSession) -> None:
    """Makes ``stft`` a table function of SQL: ``SELECT ... FROM chunks, LATERAL stft(samples, right, start, frames, 1024, 256)``."""
    spark.udtf.register("stft", F.udtf(Stft, returnType="frame: bigint, mag: array<float>", useArrow=True))
