"""Token ids in binary files: every id takes the fewest bits that the vocabulary needs.

A file holds blocks of ``BLOCK`` ids, packed without gaps; then where each document begins, where each
block begins, and a footer. Fixed widths and block offsets make any range of ids one ranged read, unpacked
by numpy: eight ids share ``bits`` whole bytes, so each of the eight is a few shifts of strided columns.

Documents are dealt by ranges of their id and sorted within each, so files follow one another in order.
Tasks write files of their own, and only what they report when all have ended enters the manifest: files
of lost or repeated tasks are never read and are deleted. The manifest has one entry a file.

A tokenizer that never joins across white space gives for a text what it gives for its parts between
white space. Arrow splits a batch and numbers its distinct parts; each worker remembers the ids of two generations of
up to ``KNOWN`` parts (what is asked for moves to the young one, the old one is dropped when that is full; parts over
``LONG`` bytes are encoded anew), and the ids of a batch are gathered by those numbers. Unknown parts are encoded
``TOGETHER`` at a time and told apart by tokens that end a word, or by their places. Where the tokenizer lowers letters and cuts
them from marks (:func:`separable`), ASCII words are remembered without their case and the marks after them. :func:`encoded` takes whole texts
instead where ``by_words`` is off.

Defined results: a null text is empty and still has its end id; rows with a null id come first; rows of
one id follow each other, ordered by a hash of their text; an empty table gives a manifest without files;
other columns are ignored. A file ends with the document that reaches ``FILE_IDS`` ids: a long document makes a longer file.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tonegrid.llm.common import WRITTEN, pieces, shared_dir, table, text_of

#: Ids of a block (a multiple of eight), ids after which a file ends, ids that a reader unpacks at once.
BLOCK, FILE_IDS, READ_IDS = 4096, 1 << 25, 1 << 20
KNOWN, LONG, TOGETHER = 3 << 17, 64, 256
#: Bytes of text whose parts are numbered at once.
PIECE = 8 << 20
#: ASCII characters that are neither letters nor digits, nor begin a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Pre-tokenizers' patterns that cut letters from what is neither letter, digit nor white space.
CUTTING = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
MANIFEST = "manifest.json"
_MAGIC, _FOOTER = b"TGPACK01", struct.Struct("<IIQQQQ8s")


def width(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids, bits: int) -> bytes:
    """``ids`` at ``bits`` bits each, lowest bits first; filled up with zeros to eight ids."""
    import numpy as np

    lanes = np.zeros(-(-len(ids) // 8) * 8, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, 8)
    out = np.zeros((len(lanes), bits), np.uint8)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for byte in range((shift + bits + 7) // 8):
            out[:, first + byte] |= (value >> np.uint64(8 * byte)).astype(np.uint8)
    return out.tobytes()


def unpack(raw: bytes, bits: int, n: int):
    """The first ``n`` ids of what :func:`pack` gave."""
    import numpy as np

    columns = np.frombuffer(raw, np.uint8)[: -(-n // 8) * bits].reshape(-1, bits)
    out = np.empty((len(columns), 8), np.uint32)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        value = np.zeros(len(columns), np.uint64)
        for byte in range((shift + bits + 7) // 8):
            value |= columns[:, first + byte].astype(np.uint64) << np.uint64(8 * byte)
        out[:, lane] = value >> np.uint64(shift) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, as Spark's own readers and writers take it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, in order."""

    partition: int
    files: list = field(default_factory=list)


class _File:
    """One file as it is written: blocks go out as they fill."""

    def __init__(self, store, path: str, bits: int):
        self.out, self.bits, self.open = store.open_output_stream(path), bits, []
        self.waiting = self.n = 0
        self.at = self.out.write(_MAGIC) or len(_MAGIC)
        self.offsets, self.docs, self.starts = [self.at], [], []

    def add(self, doc, ids) -> None:
        self.docs.append(doc)
        self.starts.append(self.n)
        self.open.append(ids)
        self.n += len(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * BLOCK:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        import numpy as np

        ids = np.concatenate(self.open) if self.open else np.empty(0, np.uint32)
        for at in range(0, n, 64 * BLOCK):
            raw = pack(ids[at : min(n, at + 64 * BLOCK)], self.bits)
            self.out.write(raw)
            step = BLOCK * self.bits // 8
            self.offsets += [self.at + min(b + step, len(raw)) for b in range(0, len(raw), step)]
            self.at += len(raw)
        self.open, self.waiting = [ids[n:]], len(ids) - n

    def close(self, kind: pa.DataType) -> dict:
        import numpy as np

        self._flush(self.waiting)
        index = pa.record_batch([pa.array(self.docs, kind), pa.array(self.starts, pa.int64())], ["doc_id", "start"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_batch(index)
        raw, offsets = sink.getvalue(), np.array(self.offsets, "<u8").tobytes()
        self.out.write(raw)
        self.out.write(offsets)
        self.out.write(_FOOTER.pack(self.bits, BLOCK, self.n, len(self.docs), self.at, self.at + raw.size, _MAGIC))
        self.out.close()
        return {"n_ids": self.n, "n_docs": len(self.docs)}


class PackedFile:
    """A file opened for reading: documents, block offsets, and any range of its ids."""

    def __init__(self, path: str):
        import numpy as np

        store, local = _store(path)
        self.input = store.open_input_file(local)
        size = self.input.size()
        self.bits, self.block, self.n_ids, self.n_docs, index, offsets, magic = _FOOTER.unpack(self.input.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no file of packed token ids")
        found = pa.ipc.open_stream(self.input.read_at(offsets - index, index)).read_all().combine_chunks()
        self.docs = found["doc_id"].combine_chunks() if found.num_rows else pa.array([], found.schema.field("doc_id").type)
        self.starts = np.append(found["start"].to_numpy(), self.n_ids)
        self.offsets = np.frombuffer(self.input.read_at(size - _FOOTER.size - offsets, offsets), "<u8")

    def ids(self, start: int, stop: int):
        """The ids from ``start`` to ``stop`` (exclusive): the blocks that hold them are one read."""
        import numpy as np

        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        low, high = int(self.offsets[first]), int(self.offsets[last + 1])
        return unpack(self.input.read_at(high - low, low), self.bits, stop - first * self.block)[start - first * self.block :]

    def close(self) -> None:
        self.input.close()


def manifest(path: str) -> dict:
    store, local = _store(path)
    with store.open_input_stream(f"{local}/{MANIFEST}") as f:
        return json.loads(f.read())


class PackedTokens(DataSource):
    """``format("packed_tokens")``: writes (doc_id, ids) rows, reads (doc_id, start, n_tokens, ids).

    ``ids`` are little-endian unsigned 32-bit integers. Options to write: ``path``, ``bits``, ``file_ids``.
    """

    @classmethod
    def name(cls) -> str:
        return "packed_tokens"

    def schema(self) -> str:
        return f"doc_id {manifest(self.options['path'])['doc_id']}, start long, n_tokens long, ids binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackedReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("files of packed tokens are written once, to a new folder: use mode('append')")
        return PackedWriter(self.options["path"], int(self.options["bits"]), int(self.options.get("file_ids", FILE_IDS)), schema["doc_id"].dataType.simpleString())


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, bits: int, file_ids: int, kind: str):
        self.path, self.bits, self.file_ids, self.kind = path, bits, file_ids, kind

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import numpy as np
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = _store(self.path)
        store.create_dir(folder)
        done, current, name, kind = Written(context.partitionId()), None, "", pa.null()

        def close() -> None:
            done.files.append({"name": name} | current.close(kind))

        for batch in iterator:
            kind = batch["doc_id"].type
            for doc, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                if current is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done.files):05d}.ids"
                    current = _File(store, f"{folder}/{name}", self.bits)
                current.add(doc, np.frombuffer(ids.as_buffer(), "<u4"))
                if current.n >= self.file_ids:
                    close()
                    current = None
        if current is not None:
            close()
        return done

    def _tidy(self, keep: set[str]) -> None:
        from pyarrow import fs

        store, folder = _store(self.path)
        for found in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if found.base_name.endswith(".ids") and found.base_name not in keep:
                store.delete_file(found.path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, start = [], 0
        for task in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for file in task.files:
                files.append(file | {"start": start})
                start += file["n_ids"]
        self._tidy({f["name"] for f in files})
        store, folder = _store(self.path)
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"doc_id": self.kind, "bits": self.bits, "n_ids": start, "files": files}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._tidy(set())


@dataclass
class _OneFile(InputPartition):
    name: str
    start: int


class PackedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_OneFile(f["name"], f["start"]) for f in manifest(self.path)["files"]] or [_OneFile("", 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if not partition.name:
            return
        file = PackedFile(f"{self.path}/{partition.name}")
        first = 0
        while first < file.n_docs:
            last = max(first + 1, int(np.searchsorted(file.starts, file.starts[first] + READ_IDS, "right")) - 1)
            starts = file.starts[first : last + 1]
            ids = file.ids(int(starts[0]), int(starts[-1])).astype("<u4")
            offsets = ((starts - starts[0]) * 4).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [file.docs.slice(first, last - first), pa.array(starts[:-1] + partition.start), pa.array(np.diff(starts)), texts], ["doc_id", "start", "n_tokens", "ids"]
            )
            first = last
        file.close()


#: Of this worker process, by tokenizer: (tokenizer, the ids of parts of texts).
_LOADED: dict[str, tuple] = {}


def separable(definition: dict) -> bool:
    """Whether an ASCII part of letters and marks after them has the ids of its letters in lower case, then those of its marks."""
    normal = definition.get("normalizer") or {}
    kinds = [n["type"] for n in normal.get("normalizers", [normal]) if n]
    cuts = definition.get("pre_tokenizer") or {}
    first, *rest = cuts.get("pretokenizers", [cuts])
    return (
        "Lowercase" in kinds and {*kinds} <= {"NFC", "Lowercase", "Replace"} and all(n.get("pattern") == {"Regex": r"\s+"} for n in normal.get("normalizers", []) if n["type"] == "Replace")
        and first.get("type") == "Split" and first["pattern"].get("Regex") in CUTTING and first["behavior"] == "Removed" and first["invert"]
        and all(c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c["use_regex"] for c in rest)
        and all(any(a in MARKS and b.isalpha() for a, b in zip(t["content"], t["content"][1:], strict=False)) for t in definition.get("added_tokens", []))
    )


class Parts:
    """Ids of parts of texts between white space, remembered within bounds."""

    def __init__(self, tokenizer, suffix: str | None = None, cut: bool = False):
        import numpy as np

        self.tokenizer, self.cut = tokenizer, cut
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ends = None
        if suffix:
            self.ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
            self.ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each part, encoded in one text: words of letters by the tokens that end them, others from the token of their first character on."""
        import numpy as np

        if self.ends is not None and all(map(str.isalpha, texts)):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(texts) and stops[-1] == len(ids):
                raw = ids.tobytes()
                return [raw[4 * a : 4 * b] for a, b in zip([0, *stops], stops, strict=False)]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        raw, at, starts = np.array(found.ids, "<u4").tobytes(), 0, []
        for t in texts:
            starts.append(found.char_to_token(at))
            at += len(t) + 1
        if None in starts:  # a first character without a token
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        return [raw[4 * a : 4 * b] for a, b in zip(starts, [*starts[1:], len(found.ids)], strict=True)]

    def known(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts."""
        found = list(map(self.young.get, parts))
        rest = [i for i, ids in enumerate(found) if ids is None]
        if rest and len(self.young) + len(rest) > KNOWN:
            self.young, self.old = {}, self.young
        names = [parts[i] for i in rest]
        more = list(map(self.old.get, names))
        texts, unknown = list(map(bytes.decode, names)), ([], [])
        for n, ids in enumerate(more):
            if ids is None:
                unknown[texts[n].isalpha()].append(n)
        for kind in unknown:
            for at in range(0, len(kind), TOGETHER):
                some = kind[at : at + TOGETHER]
                for n, ids in zip(some, self.encoded([texts[n] for n in some]), strict=True):
                    more[n] = ids
        for i, ids in zip(rest, more, strict=True):
            found[i] = ids
        self.young.update((t, ids) for t, ids in zip(names, more, strict=True) if len(t) <= LONG)
        return found

    def pooled(self, parts: pa.Array):
        """(ids of all parts, one after another, how many each has); where letters and marks can be told apart, what is asked for and remembered is letters in lower case, and marks."""
        import numpy as np
        import pyarrow.compute as pc

        second = None
        if self.cut:
            low = pc.ascii_lower(parts)
            head = pc.ascii_rtrim(low, MARKS)
            good = pc.and_(pc.string_is_ascii(low), pc.ascii_is_alpha(head))
            second = pc.if_else(good, pc.ascii_ltrim(low, LETTERS), "").dictionary_encode()
            parts = pc.if_else(good, head, parts).dictionary_encode()
            indices, parts = parts.indices.to_numpy(), parts.dictionary
        ids = self.known(parts.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        if second is not None:
            marks = second.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            some = [m for m in marks if m]
            of = dict(zip(some, self.known(some), strict=True))
            ids += [of.get(m, b"") for m in marks]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        if second is None:
            return pool, sizes
        which = np.stack((indices, second.indices.to_numpy() + len(parts)), 1).reshape(-1)
        return gathered(pool, sizes, which)[0], sizes[which].reshape(-1, 2).sum(1)

    def texts(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The ids of each text, as bytes, ``end`` after them."""
        import numpy as np
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds -= bounds[0]
        pool, sizes = self.pooled(words.dictionary)
        pool, sizes = np.concatenate((pool, np.frombuffer(end, "<u4"))), np.append(sizes, len(end) // 4)
        # every text ends with one more part, which stands for the end
        tokens, upto = gathered(pool, sizes, np.insert(words.indices.to_numpy(), bounds[1:], len(sizes) - 1))
        offsets = 4 * upto[bounds + np.arange(len(bounds))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(tokens)])


def gathered(pool, sizes, which):
    """(the ids of the parts ``which``, of the ``sizes`` of all that ``pool`` holds one after another; where each begins and the last ends)."""
    import numpy as np

    begins, many = np.cumsum(sizes) - sizes, sizes[which]
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(many)))
    kind = np.int32 if max(len(pool), upto[-1]) < 1 << 31 else np.int64
    return pool[np.repeat((begins[which] - upto[:-1]).astype(kind), many) + np.arange(upto[-1], dtype=kind)], upto


def _encode(definition: str, end_id: int | None, by_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        if definition not in _LOADED:
            _LOADED.clear()
            tokenizer = Tokenizer.from_str(definition)
            told = json.loads(definition)
            _LOADED[definition] = (tokenizer, Parts(tokenizer, told["model"].get("end_of_word_suffix"), separable(told)))
        tokenizer, parts = _LOADED[definition]
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in batches:
            first = 0
            for some in pieces(batch["text"], PIECE):
                if by_words:
                    ids = parts.texts(some, end)
                else:
                    ids = pa.array([np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + end for t in some.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, len(some)), ids], ["doc_id", "ids"])
                first += len(some)

    return run


def encoded(rows: DataFrame, tokenizer: str, end_id: int | None = None, by_words: bool = True) -> DataFrame:
    """(doc_id, ids) of rows (doc_id, text); ``tokenizer`` is the JSON of one of the tokenizers library.

    ``by_words`` needs a tokenizer that drops white space (ASCII's at least) before it looks for tokens, and joins nothing across it.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id, by_words), f"doc_id {kind}, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, by_words: bool = True, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes ``docs`` into files under ``path`` (a new folder that driver and executors share), in ascending order of ids; returns the full path."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # some MB; executors get it with the task
        definition = f.read()
    vocabulary = Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True)
    path = qualified(spark, path)
    text = text_of(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    spark.dataSource.register(PackedTokens)
    bits = width(max(vocabulary, (end_id or 0) + 1))
    encoded(ordered, definition, end_id, by_words).write.format("packed_tokens").option("bits", bits).option("file_ids", file_ids).mode("append").save(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document of the files, ``start`` counts the ids of all documents before it."""
    spark.dataSource.register(PackedTokens)
    return spark.read.format("packed_tokens").load(qualified(spark, path))


def read_ids(path: str, start: int, n: int):
    """``n`` ids from position ``start`` on, counted over all files: reads only the blocks that hold them."""
    import numpy as np

    out = [np.empty(0, np.uint32)]
    for file in manifest(path)["files"]:
        low, high = max(start, file["start"]), min(start + n, file["start"] + file["n_ids"])
        if low < high:
            opened = PackedFile(f"{path}/{file['name']}")
            out.append(opened.ids(low - file["start"], high - file["start"]))
            opened.close()
    return np.concatenate(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tonegrid/{uuid.uuid4().hex}"
    path = write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    WRITTEN.append(path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
