"""SimHash near-dedup with pivot distance tables.

Fingerprints: every shingle of ``shingle`` words is hashed to 64 bits; a bit of the fingerprint is 1
where over half of the hashes have it. Links are between *distinct* fingerprints, so copies of one
text are one node however many rows they fill.

Links at ``max_bits`` or fewer differing bits, without all pairs and without losing one:

1. The 64 bits are cut into blocks; two fingerprints within ``max_bits`` agree on at least
   ``blocks - max_bits`` whole blocks. Every choice of that many blocks is a bucket key. The number
   of blocks follows the number of fingerprints, so that an ordinary bucket stays small.
2. In a bucket, pairs are discarded by their pivot tables: the distances to ``PIVOTS`` reference
   fingerprints are computed once per fingerprint, and by the triangle inequality the largest
   difference of two tables is a lower bound of the pair's distance. Survivors are verified on the
   fingerprints themselves. Dense buckets (groups of near copies) are compared by blocks, and only
   links leave a task: see :mod:`tonegrid.llm.blocks`.

Defined results: texts of any length are read whole; null, empty and all-blank texts have fingerprint zero; fewer words than a shingle
are one shingle; null doc_ids keep their row and never name a component unless all of it are null;
repeated rows share a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm.blocks import BLOCK, bucket_components, joined, partners
from tonegrid.llm.common import content_key, table, text_of, written

SHINGLE, MAX_BITS, SEED = 4, 4, 42
PIVOTS = 16


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of the shingles of a text, as a uint64 array; ASCII rules (case, white space) are those of bytes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    return np.fromiter([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8", len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, as a signed 64-bit integer. Bits are counted in pieces, so memory stays bounded."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprint(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(t.as_buffer().to_pybytes(), shingle)) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["a"], batch["b"], pa.array(prints, pa.int64())], ["doc_id", "a", "b", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k, fp), one small row per document, written once."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_of(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), content_key(text).alias("k"))
    rows = rows.select("doc_id", "text", "k.a", "k.b").mapInArrow(_fingerprint(shingle), f"doc_id {kind}, a long, b long, fp long")
    return written(rows.select("doc_id", F.struct("a", "b").alias("k"), "fp"))


def _mask(first: int, n: int) -> int:
    value = ((1 << n) - 1) << first
    return value - (1 << 64) if value >= 1 << 63 else value


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the first values of a 64-bit Weyl sequence mixed by SplitMix64, as signed integers."""
    out, full = [], (1 << 64) - 1
    for i in range(1, n + 1):
        z = i * 0x9E3779B97F4A7C15 & full
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & full
        z = (z ^ z >> 27) * 0x94D049BB133111EB & full
        z ^= z >> 31
        out.append(z - (1 << 64) if z >= 1 << 63 else z)
    return out


def pivot_tables(fps: np.ndarray) -> np.ndarray:
    """Distances of all fingerprints (unsigned) to all pivots, a row each."""
    return np.bitwise_count(fps[:, None] ^ np.array([p & (1 << 64) - 1 for p in pivots()], np.uint64)).astype(np.int16)


def within(fps: np.ndarray, tables: np.ndarray, i: int, other: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of ``other`` differ from ``i`` in ``max_bits`` or fewer bits: by the largest difference of tables, then on the fingerprints."""
    other = other[np.abs(tables[other] - tables[i]).max(1, initial=0) <= max_bits]
    return other[np.bitwise_count(fps[other] ^ fps[i]) <= max_bits]


def block_count(distinct: int, max_bits: int) -> int:
    """Blocks so that a bucket holds about four of ``distinct`` even fingerprints, at least two more than max_bits."""
    for blocks in range(max_bits + 2, 3 * max_bits + 3):
        if distinct / 2 ** (64 * (blocks - max_bits) / blocks) <= 4:
            return blocks
    return 3 * max_bits + 3


def bucket_keys(fp: Column, blocks: int, max_bits: int) -> Column:
    """All bucket keys of a fingerprint: the bits of each choice of blocks that a link must leave whole, with its number."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = reduce(lambda x, y: x | y, [_mask(cuts[b], cuts[b + 1] - cuts[b]) for b in chosen])
        keys.append(F.struct(F.lit(i).cast("smallint").alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def bit_links(max_bits: int):
    """A linker of nodes that are fingerprints."""

    def link(unit: pa.Table) -> list[tuple[int, int]]:
        nodes, rest, roots = (unit[c].to_numpy() for c in ("node", "rest", "root"))
        order = np.lexsort((rest, nodes))
        nodes, rest, label = nodes[order], rest[order], np.unique(roots[order], return_inverse=True)[1]
        fps = nodes.view(np.uint64)
        tables, out = pivot_tables(fps), []
        for i in range(len(nodes)):
            out += joined(i, within(fps, tables, i, partners(i, label, rest), max_bits), nodes, label)
        return out

    return link


def classes(rows: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of ``rows``; the smallest doc_id names a component."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    keys = bucket_keys(F.col("fp"), block_count(nodes.count(), max_bits), max_bits)
    keyed = nodes.select(F.explode(keys).alias("k"), F.col("fp").alias("node")).select(F.xxhash64("k.choice", "k.bits").alias("key"), "node", F.lit(0).alias("weight"))
    roots = bucket_components(keyed, None, bit_links(max_bits), block)
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(named, "root").select("fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(table(spark, sf_dir, "documents"))
    return rows.join(classes(rows), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
