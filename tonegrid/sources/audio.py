"""``format("audio")``: audio files as a data source that cuts them by bytes, so that many tasks share a long file.

The driver lists files and their sizes, no more. A task gets ranges of bytes: parts of long files, or
many short ones. It reads each file's header, and owns the chunks whose first byte lies in its range;
it reads the frames of those and of their halos, each once, and holds one chunk with its halos at a time.

What is read (option ``what``):

* ``chunks``: the chunk rows of :mod:`tonegrid.sources.wav`; files are known by their path;
* ``headers``: a row for each file without reading its samples;
* ``hashes``: SHA-256 of each file, streamed; that is one task a file, as a hash is sequential by nature.

The options ``files`` (paths) and ``channels`` restrict the listing and the decoding; filters are left to Spark. Files that can't
be read, empty ones as well, become one row with an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tonegrid.sources import formats, wav
from tonegrid.sources.files import listed, qualified, store

#: Bytes that a task gets; each file counts as so many bytes more, for being opened.
SPLIT, OPEN_COST = 128 << 20, 4 << 20
#: Zero crossings of the resampling filter to either side.
TAPS = 10
HEADERS = "file_id string, source_path string, size long, channels int, sample_rate int, frames long, bit_depth int, error string"
HASHES = "source_path string, file_sha256 string"
_CHUNK_TYPES = pa.schema([
    ("file_id", pa.string()), ("source_path", pa.string()), ("file_sha256", pa.string()), ("channel", pa.int32()), ("channels", pa.int32()), ("sample_rate", pa.int32()), ("frames", pa.int64()),
    ("bit_depth", pa.int32()), ("start", pa.int64()), ("samples", pa.list_(pa.float32())), ("left", pa.list_(pa.float32())), ("right", pa.list_(pa.float32())), ("error", pa.string()),
])


@dataclass
class Ranges(InputPartition):
    """(path, size, first byte, byte after the last) of each piece."""

    pieces: list


def deal(files: list[tuple[str, int]], split: int, whole: bool = False) -> list[list[tuple[str, int, int, int]]]:
    """Pieces of files dealt to tasks: long files are cut every ``split`` bytes, short ones share a task."""
    out, open_, room = [], [], 0
    for path, size in files:
        step = max(size, 1) if whole else split
        for low in range(0, max(size, 1), step):
            piece = path, size, low, min(low + step, max(size, 1))
            cost = piece[3] - low + OPEN_COST
            if open_ and room + cost > split:
                out.append(open_)
                open_, room = [], 0
            open_.append(piece)
            room += cost
    return [*out, open_] if open_ else out


class _Frames:
    """Frames of an open file; what the last request has in common with the next isn't read again."""

    def __init__(self, file, of: formats.Layout):
        self.file, self.of, self.at = file, of, 0
        self.held = np.empty((of.channels, 0), np.float32)

    def between(self, low: int, high: int) -> np.ndarray:
        end = self.at + self.held.shape[1]
        if not self.at <= low <= end:
            self.at, self.held, end = low, self.held[:, :0], low
        if high > end:
            new = formats.samples(self.file.read_at((high - end) * self.of.width, self.of.data + end * self.of.width), self.of)
            self.held = np.concatenate((self.held[:, low - self.at :], new), 1)
            self.at = low
        return self.held[:, low - self.at : high - self.at]


class Resampled:
    """Frames of a file at another rate, by a Kaiser-windowed sinc at the rational ratio of the rates; any range of them is the same whatever is asked for."""

    def __init__(self, frames: _Frames, rate: int):
        of = frames.of
        g = int(np.gcd(rate, of.rate))
        self.frames, self.up, self.down = frames, rate // g, of.rate // g
        self.half = TAPS * max(self.up, self.down)
        n = np.arange(-self.half, self.half + 1)
        h = np.sinc(n / max(self.up, self.down)) * np.kaiser(len(n), 5.0)
        self.h = h * self.up / h.sum()
        self.total = -(-of.frames * self.up // self.down)

    def source(self, frame: int) -> int:
        """The frame of the file that lies at a frame of the output, or before it."""
        return frame * self.down // self.up

    def between(self, low: int, high: int) -> np.ndarray:
        out = np.arange(low, high) * self.down
        first = -(-(out - self.half) // self.up)  # of the zero-stuffed signal only every up-th sample is one of the file
        taps = np.arange(2 * self.half // self.up + 1)
        begin, end = max(0, int(first[0])), min(self.frames.of.frames, int(first[-1]) + len(taps))
        x = self.frames.between(begin, end).astype(np.float64)
        y = np.zeros((len(x), len(out)))
        for tap in taps:
            at = first + tap
            lag = out - at * self.up + self.half
            inside = (at >= begin) & (at < end) & (lag >= 0) & (lag < len(self.h))
            y += np.where(inside, self.h[np.clip(lag, 0, len(self.h) - 1)], 0.0) * x[:, np.clip(at - begin, 0, max(0, end - begin - 1))]
        return y.astype(np.float32)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))


class AudioReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob, self.what = options["path"], options.get("glob", "*"), options.get("what", "chunks")
        self.split, self.after_s = int(options.get("split", SPLIT)), float(options.get("after_s", wav.AFTER_S))
        self.chunk, self.before = int(options.get("chunk", wav.CHUNK)), int(options.get("before", wav.BEFORE))
        self.rate = int(options.get("resample", 0))
        # asked for by options, not by pushed filters: Spark shares one set of pushed filters among all scans of a relation in a query,
        # so that a union of two of its channels would get one of them twice
        self.paths = set(json.loads(options["files"])) if options.get("files") else None
        self.channels = set(json.loads(options["channels"])) if options.get("channels") else None

    def partitions(self) -> list[InputPartition]:
        files = [f for f in listed(self.path, self.glob) if self.paths is None or f[0] in self.paths]
        return [Ranges(pieces) for pieces in deal(files, self.split, self.what != "chunks")] or [Ranges([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        read = {"chunks": self._chunks, "headers": self._header, "hashes": self._hash}[self.what]
        for path, size, low, high in partition.pieces:
            at, local = store(path)
            with at.open_input_file(local) as file:
                yield from read(file, path, size, low, high)

    def _layout(self, file, path: str, size: int) -> formats.Layout:
        if not path.lower().endswith(wav.SUFFIXES):
            raise formats.AudioError("unsupported file type")
        if not path.lower().endswith(READABLE):
            raise formats.AudioError("no decoder for this file type")
        return formats.layout(lambda at, n: file.read_at(n, at), size)

    def _header(self, file, path: str, size: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        said, of = None, None
        try:
            of = self._layout(file, path, size)
        except formats.AudioError as error:
            said = str(error)
        values = (path, path, size, *((of.channels, of.rate, of.frames, of.depth) if of else (None,) * 4), said)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in HEADERS.split(", ")])

    def _hash(self, file, path: str, size: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        digest = sha256()
        while piece := file.read(1 << 20):
            digest.update(piece)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], ["source_path", "file_sha256"])

    def _chunks(self, file, path: str, size: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        try:
            of = self._layout(file, path, size)
        except formats.AudioError as error:
            if low == 0:
                yield pa.RecordBatch.from_pylist([{"file_id": path, "source_path": path, "error": str(error)}], _CHUNK_TYPES)
            return
        frames: _Frames | Resampled = _Frames(file, of)
        rate, total, source = of.rate, of.frames, lambda frame: frame
        if self.rate and self.rate != of.rate:
            frames = Resampled(frames, self.rate)
            rate, total, source = self.rate, frames.total, frames.source
        after = int(np.ceil(rate * self.after_s)) + 1
        for start in range(0, total, self.chunk):
            if not low <= of.data + source(start) * of.width < high:
                continue  # another task's chunk
            end = min(start + self.chunk, total)
            begin, stop = max(0, start - self.before), min(end + after, total)
            x = frames.between(begin, stop)
            signals = list(enumerate(x)) + ([(wav.MIX, x.mean(0, dtype=np.float32))] if of.channels > 1 else [])
            signals = [(c, v) for c, v in signals if self.channels is None or c in self.channels]
            if not signals:
                return
            n = len(signals)
            parts = [[v[a - begin : b - begin] for _, v in signals] for a, b in ((start, end), (begin, start), (end, stop))]
            same = [pa.array([v] * n, k) for v, k in ((path, pa.string()), (path, pa.string()), (None, pa.string()))]
            head = [pa.array([v] * n, k) for v, k in ((of.channels, pa.int32()), (rate, pa.int32()), (total, pa.int64()), (of.depth, pa.int32()), (start, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array([c for c, _ in signals], pa.int32()), *head, *map(_lists, parts), pa.array([None] * n, pa.string())], schema=_CHUNK_TYPES)


#: Suffixes that this source decodes.
READABLE = (".wav", ".aiff", ".aif")


class AudioSource(DataSource):
    """Options: ``path``, ``what``, ``glob``, ``split`` (bytes a task), ``chunk``, ``before`` (frames), ``after_s``, ``resample`` (a rate), ``files`` (paths) and ``channels`` (JSON lists of those that are read at all)."""

    @classmethod
    def name(cls) -> str:
        return "audio"

    def schema(self) -> str:
        what = self.options.get("what", "chunks")
        if what not in ("chunks", "headers", "hashes"):
            raise ValueError(f"what is chunks, headers or hashes, not {what!r}")
        return {"chunks": wav.SCHEMA, "headers": HEADERS, "hashes": HASHES}[what]

    def reader(self, schema: StructType) -> DataSourceReader:
        return AudioReader(dict(self.options))


def _source(spark: SparkSession, path: str, what: str, glob: str, **options) -> DataFrame:
    spark.dataSource.register(AudioSource)
    return spark.read.format("audio").options(what=what, glob=glob, **{k: str(v) for k, v in options.items()}).load(qualified(spark, path))


def scan_audio(spark: SparkSession, path: str, glob: str = "*", **options) -> DataFrame:
    """Chunk rows of all files under ``path``; a file is known by its path, and as many tasks read it as its bytes ask for."""
    return _source(spark, path, "chunks", glob, **options)


def audio_headers(spark: SparkSession, path: str, glob: str = "*", **options) -> DataFrame:
    """What each file says of itself, as :func:`tonegrid.sources.wav.subjects`; no samples are read, but each file once for its hash."""
    files = _source(spark, path, "headers", glob, **options)
    named = files.join(file_hashes(spark, path, glob), "source_path").withColumns({"channel": F.lit(0)})
    return wav.subjects(named)


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(source_path, file_sha256) of each file."""
    return _source(spark, path, "hashes", glob)
