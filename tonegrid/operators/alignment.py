"""Signals against references of any length: alignment by all lags, and what is then measured of the aligned pair.

The cross-correlation of two signals is a product of their spectra. A transform of N = rows x ``ROW`` points is
taken in two steps, as transforms of columns, a twist, and transforms of rows; between the steps blocks of
cells change hands in a shuffle. So no task holds more than ``CELLS`` samples of either signal however long they
are, and the work grows as N log N, not as the square that all pairs of blocks would cost.

A pair is (file_id, reference): a file and the name of what it is compared with. Signals that differ in length
are cut to the shorter one before they are aligned. Of lags that correlate alike to nine digits the smallest counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.operators.events import beside
from tonegrid.operators.kernels import floats, mapped
from tonegrid.sources.wav import mono

#: Points of a row of the transform, and cells of a block.
ROW, CELLS = 1 << 15, 1 << 20
#: Aligned samples of a block; windows of WINDOW samples every HOP reach into the next one. Blocks begin at multiples of the hop.
BLOCK = 1 << 16
#: Windows of the envelope's similarity, and the frame of the spectral one.
WINDOW, HOP, FRAME = 256, 128, 1024
TINY = 1e-12
PAIR = ["file_id", "reference"]


def shape(n: int) -> tuple[int, int, int]:
    """(rows, columns of a block of columns, rows of a block of rows) of the transform that holds all lags of ``n`` samples."""
    rows = 1 << int(np.ceil(np.log2(max(1, -(-2 * n // ROW)))))
    return rows, max(1, min(ROW, CELLS // rows)), min(rows, CELLS // ROW)


def paired(degraded: DataFrame, references: DataFrame) -> DataFrame:
    """(file_id, reference, given, n, start, samples): chunks of both sides of each pair, ``given`` those of the reference; n samples count.

    ``references`` are chunk rows with a name, at every sample rate that files have.
    """
    lengths = references.groupBy("reference", "sample_rate").agg(F.max("frames").alias("there"))
    files = degraded.groupBy("file_id", "sample_rate").agg(F.max("frames").alias("here"))
    pairs = files.join(F.broadcast(lengths), "sample_rate").select(*PAIR, "sample_rate", F.least("here", "there").alias("n"))
    sides = (
        beside(degraded.drop("reference"), pairs.drop("sample_rate")).withColumn("given", F.lit(False)),
        beside(references.drop("file_id"), pairs, "reference", "sample_rate").withColumn("given", F.lit(True)),
    )
    rows = [s.select(*PAIR, "given", "n", "start", "samples") for s in sides]
    return rows[0].union(rows[1]).where("start < n")


def _batch(keys: pa.RecordBatch | pa.Table, names: list[str], row: int, columns: dict) -> pa.RecordBatch:
    """Columns of as many rows as the first one has, behind ``names`` of one row of ``keys``."""
    many = len(next(iter(columns.values())))
    kept = [pa.array([keys[c][row].as_py()] * many, keys.schema.field(c).type) for c in names]
    return pa.RecordBatch.from_arrays([*kept, *columns.values()], [*names, *columns])


def _lists(cells: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([c.size for c in cells]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([c.ravel() for c in cells]), kind))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to pieces of columns."""
    for batch in batches:
        for row in range(batch.num_rows):
            start, n = batch["start"][row].as_py(), batch["n"][row].as_py()
            x, (_, wide, _) = floats(batch, "samples", row)[: n - start], shape(n)
            first, skip = divmod(start, ROW)
            filled = np.zeros(-(-(skip + len(x)) // ROW) * ROW, np.float32)
            filled[skip : skip + len(x)] = x
            lines = filled.reshape(-1, ROW)
            many = ROW // wide
            yield _batch(batch, [*PAIR, "given", "n"], row, {
                "block": pa.array(np.arange(many), pa.int32()), "at": pa.array(np.full(many, first), pa.int32()),
                "cells": _lists([lines[:, i * wide : (i + 1) * wide] for i in range(many)], pa.float32()),
            })


def _cells(table: pa.Table, row: int) -> np.ndarray:
    return table["cells"][row].values.to_numpy(zero_copy_only=False)


def _twist(rows: np.ndarray, columns: np.ndarray, n: int, sign: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi / n * (np.multiply.outer(rows, columns) % n))


def _columns(table: pa.Table) -> pa.Table:
    """A block of columns of both signals, transformed and twisted, in pieces for the blocks of rows."""
    n, block = table["n"][0].as_py(), table["block"][0].as_py()
    rows, wide, high = shape(n)
    x = np.zeros((2, rows, wide))
    for row, (given, at) in enumerate(zip(table["given"].to_pylist(), table["at"].to_pylist(), strict=True)):
        piece = _cells(table, row).reshape(-1, wide)
        x[int(given), at : at + len(piece)] += piece
    y = np.fft.fft(x, axis=1) * _twist(np.arange(rows), np.arange(block * wide, (block + 1) * wide), rows * ROW, -1)
    many = rows // high
    pieces = [np.ascontiguousarray(y[:, i * high : (i + 1) * high]).view(np.float64) for i in range(many)]
    out = {"block": pa.array(np.arange(many), pa.int32()), "at": pa.array(np.full(many, block), pa.int32()), "cells": _lists(pieces, pa.float64())}
    return pa.Table.from_batches([_batch(table, [*PAIR, "n"], 0, out)])


def _rows(table: pa.Table) -> pa.Table:
    """A block of rows: the spectra, their product, and the first step back, in pieces for the blocks of columns."""
    n, block = table["n"][0].as_py(), table["block"][0].as_py()
    rows, wide, high = shape(n)
    z = np.zeros((2, high, ROW), np.complex128)
    for row, at in enumerate(table["at"].to_pylist()):
        z[:, :, at * wide : (at + 1) * wide] = _cells(table, row).view(np.complex128).reshape(2, high, wide)
    z = np.fft.fft(z, axis=2)
    z = np.fft.ifft(z[1] * z[0].conj(), axis=1) * _twist(np.arange(block * high, (block + 1) * high), np.arange(ROW), rows * ROW, 1)
    many = ROW // wide
    pieces = [np.ascontiguousarray(z[:, i * wide : (i + 1) * wide]).view(np.float64) for i in range(many)]
    out = {"block": pa.array(np.arange(many), pa.int32()), "at": pa.array(np.full(many, block), pa.int32()), "cells": _lists(pieces, pa.float64())}
    return pa.Table.from_batches([_batch(table, [*PAIR, "n"], 0, out)])


def _best(table: pa.Table) -> pa.Table:
    """The greatest correlation, by size, of a block of columns, and the least lag that has it."""
    n, block = table["n"][0].as_py(), table["block"][0].as_py()
    rows, wide, high = shape(n)
    z = np.empty((rows, wide), np.complex128)
    for row, at in enumerate(table["at"].to_pylist()):
        z[at * high : (at + 1) * high] = _cells(table, row).view(np.complex128).reshape(high, wide)
    size = np.abs(np.fft.ifft(z, axis=0).real)
    lag = np.add.outer(np.arange(rows) * ROW, np.arange(block * wide, (block + 1) * wide))
    lag = np.where(lag < n, lag, lag - rows * ROW)
    size = np.where(np.abs(lag) < n, size, -1.0)
    best = size.max()
    return pa.Table.from_batches([_batch(table, [*PAIR, "n"], 0, {"peak": pa.array([best]), "lag": pa.array([int(lag[size >= best * (1 - 1e-9)].min())], pa.int64())})])


def lags(pairs: DataFrame) -> DataFrame:
    """(file_id, reference, n, lag, peak) of :func:`paired` chunks: how many samples the reference is behind the file."""
    kind, where = "file_id string, reference string", ["file_id", "reference", "block"]
    pieces = mapped(pairs, _cut, f"{kind}, given boolean, n long, block int, at int, cells array<float>")
    twisted = pieces.groupBy(where).applyInArrow(_columns, f"{kind}, n long, block int, at int, cells array<double>")
    products = twisted.groupBy(where).applyInArrow(_rows, f"{kind}, n long, block int, at int, cells array<double>")
    found = products.groupBy(where).applyInArrow(_best, f"{kind}, n long, peak double, lag long")
    per = found.groupBy(PAIR).agg(F.max("n").alias("n"), F.max("peak").alias("peak"), F.collect_list(F.struct("peak", "lag")).alias("blocks"))
    best = F.filter("blocks", lambda b: b["peak"] >= F.col("peak") * (1 - 1e-9))
    return per.select(*PAIR, "n", F.array_min(F.transform(best, lambda b: b["lag"])).alias("lag"), "peak")


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to pieces of blocks of aligned samples; a block's last windows reach on."""
    for batch in batches:
        for row in range(batch.num_rows):
            given, start, n, lag = (batch[c][row].as_py() for c in ("given", "start", "n", "lag"))
            x, long = floats(batch, "samples", row).astype(np.float32), n - abs(lag)
            first = start - max(lag if given else -lag, 0)
            low, high = max(first, 0), min(first + len(x), long)
            if high <= low:
                continue
            blocks = range(max(low - WINDOW, 0) // BLOCK, (high - 1) // BLOCK + 1)
            spans = [(b, max(low, b * BLOCK), min(high, (b + 1) * BLOCK + WINDOW)) for b in blocks]
            spans = [s for s in spans if s[2] > s[1]]
            yield _batch(batch, [*PAIR, "given"], row, {
                "long": pa.array([long] * len(spans), pa.int64()), "block": pa.array([b for b, _, _ in spans], pa.int32()), "at": pa.array([a - b * BLOCK for b, a, _ in spans], pa.int32()),
                "cells": _lists([x[a - first : e - first] for _, a, e in spans], pa.float32()),
            })


def _measured(table: pa.Table) -> pa.Table:
    """Sums of a block of the aligned pair, its windows, and of the first block the spectral similarity."""
    long, block = table["long"][0].as_py(), table["block"][0].as_py()
    x = np.zeros((2, min(BLOCK + WINDOW, long - block * BLOCK)))
    for row, (given, at) in enumerate(zip(table["given"].to_pylist(), table["at"].to_pylist(), strict=True)):
        piece = _cells(table, row)
        x[int(given), at : at + len(piece)] = piece
    d, r = x[:, :BLOCK]
    sums = {"rr": r @ r, "re": r @ (d - r), "ee": (d - r) @ (d - r), "dd": d @ d}
    first = np.arange(0, min(BLOCK, long - WINDOW - block * BLOCK), HOP)
    dots = norms = np.empty(0)
    if len(first):
        a, b = (np.lib.stride_tricks.sliding_window_view(side, WINDOW)[first] for side in x)
        dots, norms = (a * b).sum(1), np.sqrt((a * a).sum(1) * (b * b).sum(1))
    alike = None
    if block == 0 and long >= FRAME:
        dm, rm = np.abs(np.fft.rfft(x[:, :FRAME] * np.hanning(FRAME))) + TINY
        alike = float((2 * rm * dm / (rm * rm + dm * dm)).mean())
    out = {"long": pa.array([long], pa.int64()), **{k: pa.array([float(v)]) for k, v in sums.items()}, "dots": _lists([dots], pa.float64()), "norms": _lists([norms], pa.float64()), "alike": pa.array([alike], pa.float64())}
    return pa.Table.from_batches([_batch(table, PAIR, 0, out)])


def aligned(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, reference, long, rr, re, ee, dd, dots, norms, alike): blocks of the pairs, each shifted by its lag in ``found`` (file_id, reference, lag)."""
    kind = "file_id string, reference string"
    shifted = mapped(beside(pairs, found.select(*PAIR, "lag"), *PAIR), _shift, f"{kind}, given boolean, long long, block int, at int, cells array<float>")
    return shifted.groupBy("file_id", "reference", "block").applyInArrow(_measured, f"{kind}, long long, rr double, re double, ee double, dd double, dots array<double>, norms array<double>, alike double").drop("block")


def ratio_db() -> Column:
    """Scale-invariant ratio of signal to distortion from the sums rr, re and ee, in which equal signals don't cancel."""
    less = (TINY - F.col("re")) / (F.col("rr") + TINY)  # by how much the best scale is under one
    target = (1 - less) * (1 - less) * F.col("rr") + TINY
    noise = F.greatest(F.lit(0.0), F.col("ee") + 2 * less * F.col("re") + less * less * F.col("rr")) + TINY
    return 10 * F.log10(target / noise)


def scores(blocks: DataFrame) -> DataFrame:
    """(file_id, reference, envelope, spectral, ratio_db) of :func:`aligned` blocks: mean similarity of windows from -1 to 1, spectral similarity from 1 to 5, and the ratio."""
    per = blocks.groupBy(PAIR).agg(*[F.sum(c).alias(c) for c in ("rr", "re", "ee", "dd")], F.max("alike").alias("alike"), F.max("long").alias("long"))
    whole = (F.sqrt("rr") + TINY) * (F.sqrt("dd") + TINY)
    each = F.zip_with("dots", "norms", lambda d, n: d / (n + TINY * F.col("whole")))
    windows = blocks.select(*PAIR, "dots", "norms").join(per.select(*PAIR, whole.alias("whole")), PAIR)
    means = windows.groupBy(PAIR).agg(F.try_divide(F.sum(F.aggregate(each, F.lit(0.0), lambda a, v: a + v)), F.sum(F.size("dots"))).alias("mean"))
    return per.join(means, PAIR).select(
        *PAIR, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.when(F.col("long") >= WINDOW, F.col("mean")), F.lit(0.0)))).alias("envelope"),
        (1 + 4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("alike", F.lit(0.0))))).alias("spectral"), ratio_db().alias("ratio_db"),
    )


def leakage(degraded: DataFrame, pairs: DataFrame, own: str) -> DataFrame:
    """(file_id, leakage_pct): the energy of each file's projections on references other than its own, as they lie, against all of its energy."""
    others = pairs.where(F.col("reference") != own)
    blocks = aligned(others, others.select(*PAIR).distinct().withColumn("lag", F.lit(0).cast("long")))
    per = blocks.groupBy(PAIR).agg(F.sum("rr").alias("rr"), F.sum("re").alias("re"))
    scale = (F.col("rr") + F.col("re")) / (F.col("rr") + TINY)
    leaked = per.groupBy("file_id").agg(F.sum(F.when(scale > 0, scale * scale * F.col("rr")).otherwise(0.0)).alias("leaked"))
    square = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    energy = degraded.groupBy("file_id").agg(F.sum(square).alias("energy"))
    return energy.join(leaked, "file_id", "left").select("file_id", (100 * F.coalesce("leaked", F.lit(0.0)) / (F.col("energy") + TINY)).alias("leakage_pct"))


def references_at(scan: Callable[[str, int], DataFrame], paths: dict[str, str], rates: list[int]) -> DataFrame:
    """Chunk rows of the references (name to path), once at each of the files' sample rates; ``scan`` reads a path at a rate."""
    out = None
    for name, path in paths.items():
        for rate in rates:
            rows = mono(scan(path, rate).where("error IS NULL")).select(F.lit(name).alias("reference"), "sample_rate", "frames", "start", "samples")
            out = rows if out is None else out.union(rows)
    return out
