"""Tolerances of golden values: how far analyzers move when samples are jittered by less than their precision.

Jitter is a function of seed, file, trial and frame alone, so that it is the same whatever the chunks and their halos
are, and in every rerun. A trial is a copy of each chunk under another file name; all trials are one analysis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.operators import comparison
from tonegrid.operators.analysis import analyze

#: Copies of each file, and the largest relative change of a sample.
TRIALS, JITTER = 8, 2.0**-23
SEED = 5
_MARK = "\x1f"


def uniform(key: int, frames: np.ndarray) -> np.ndarray:
    """Numbers from -1 to 1 for (key, frame), by a mixing function of the two."""
    x = frames.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)) * 2.0**-52 - 1.0


def jittered(chunks: DataFrame, trials: int = TRIALS, seed: int = SEED, most: float = JITTER) -> DataFrame:
    """``chunks`` (without errors) once for each trial, under file_id and trial; every channel of a file and their mean take the same jitter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, start = batch["key"][row].as_py(), batch["start"][row].as_py()
                parts = [batch[c][row].values.to_numpy(zero_copy_only=False) for c in ("left", "samples", "right")]
                first, out = start - len(parts[0]), []
                for x in parts:
                    u = uniform(key, np.arange(first, first + len(x)))
                    out.append(pa.array([(x.astype(np.float64) * (1 + most * u)).astype(np.float32)], pa.list_(pa.float32())))
                    first += len(x)
                named = dict(zip(("left", "samples", "right"), out, strict=True))
                one = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([named.get(c, one[c]) for c in names], names)

    names = chunks.columns
    trial = F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))
    copies = chunks.where("error IS NULL").withColumn("trial", trial).withColumn("key", F.xxhash64(F.lit(seed), "file_id", "trial"))
    copies = copies.withColumn("file_id", F.concat_ws(_MARK, "file_id", F.col("trial").cast("string"))).drop("trial")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return copies.mapInArrow(run, kinds)


def calibrated(chunks: DataFrame, profile: dict, trials: int = TRIALS, seed: int = SEED, most: float = JITTER) -> DataFrame:
    """(metric, tolerance) for each ``analyzer.metric`` of a profile that has a value in all trials."""
    found = analyze(jittered(chunks, trials, seed, most), profile | {"strict_overlay": {}}).where("value IS NOT NULL")
    name = F.split("file_id", _MARK)
    return comparison.calibrated_tolerance(found.select(F.concat_ws(".", "analyzer", "metric").alias("metric"), name[0].alias("fixture"), name[1].alias("trial"), "value"))
