"""SimHash near-dedup of documents at a shingle similarity, one document of each group kept.

At a similarity of 0.8 two fingerprints of 64 bits differ in some ten bits, beyond what blocks of
equal bits can find without near all pairs. So here the buckets come from minimum hashes of the same
shingle hashes (``BANDS`` keys of ``ROWS`` minima; a pair at 0.8 shares one with probability 0.997),
and the fingerprints do what they can at any radius: candidates are discarded by their pivot distance
tables, then by Hamming distance. All survivors are verified on the shingles themselves, in the task
that holds them, so that only links leave it: at most one fewer than the members of a unit of work,
as pairs that are connected already are not looked at again.

Documents with one set of shingles are one node. Buckets of any size are compared in full, by blocks: see
:mod:`tonegrid.llm.blocks`.

Defined results: as for the fingerprints of :mod:`tonegrid.llm.simhash`, but of distinct shingles; texts without words are one
group; the smallest doc_id of a group stays (null ones last), and of identical rows one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.llm.blocks import BLOCK, bucket_components, joined, partners
from tonegrid.llm.common import content_key, keep_rows, text_of, written
from tonegrid.llm.simhash import majority, pivot_tables, pivots, shingle_hashes, within

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 6
#: Fingerprints of pairs at the similarity differ in no more bits than this, but for one in many thousands.
MAX_BITS = 22
_ODD = np.array([(p | 1) & (1 << 64) - 1 for p in pivots(BANDS * ROWS)], np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each of ``BANDS * ROWS`` permutations of the hashes."""
    out = np.full(len(_ODD), ~np.uint64(0) if len(hashes) else np.uint64(0))
    for i in range(0, len(hashes), 1 << 11):
        part = hashes[i : i + (1 << 11)]
        part = part ^ part >> np.uint64(31)
        np.minimum(out, (_ODD[:, None] * part).min(1), out=out)
    return out


def _sketch(shingle: int):
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys, sizes = [], [], [], []
            for text in batch["text"]:
                # of each shingle once, as the similarity is one of sets: repeated lines don't move it
                hashes = np.unique(shingle_hashes(text.as_buffer().to_pybytes(), shingle))
                low = minima(hashes)
                nodes.append(xxh64_intdigest(hashes.tobytes()) - (1 << 63))
                prints.append(majority(hashes))
                keys.append([xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)])
                sizes.append(len(hashes))
            columns = (pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["a"], batch["b"], *columns], ["doc_id", "a", "b", "node", "fp", "keys", "size"])

    return run


def like_links(similarity: float):
    """A linker of nodes (fp, shingles): pairs go by sizes, pivot tables and Hamming distance, what is left by the shingles that they share."""

    def link(unit: pa.Table) -> list[tuple[int, int]]:
        nodes, rest, roots, fps = (unit[c].to_numpy() for c in ("node", "rest", "root", "fp"))
        order = np.lexsort((rest, nodes))
        nodes, rest, fps = nodes[order], rest[order], fps[order].view(np.uint64)
        sets = unit["shingles"].to_pylist()
        parts = [np.frombuffer(sets[i], np.uint32) for i in order]
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        codes = np.unique(np.concatenate(parts), return_inverse=True)[1]
        label = np.unique(roots[order], return_inverse=True)[1]
        tables = pivot_tables(fps)
        mark, out = np.zeros(codes.max(initial=0) + 1, bool), []
        for i in range(len(nodes)):
            other = partners(i, label, rest)
            other = other[(np.minimum(sizes[other], sizes[i]) >= similarity * np.maximum(sizes[other], sizes[i]) - 1e-9) & (sizes[other] > 0)]
            other = within(fps, tables, i, other, MAX_BITS)
            if not len(other):
                continue
            own = codes[ends[i] - sizes[i] : ends[i]]
            mark[own] = True
            took = np.concatenate([codes[ends[j] - sizes[j] : ends[j]] for j in other])
            same = np.add.reduceat(mark[took], np.cumsum(sizes[other]) - sizes[other], dtype=np.int64)
            mark[own] = False
            out += joined(i, other[same >= similarity * (sizes[other] + sizes[i] - same) - 1e-9], nodes, label)
        return out

    return link


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.unique(shingle_hashes(t.as_buffer().to_pybytes(), shingle)).astype(np.uint32)).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["fp"], pa.array(sets, pa.binary())], ["node", "fp", "shingles"])

    return run


def like_components(rows: DataFrame, sketched: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(node, root) of the components of like nodes of ``sketched``.

    Shingles are read a second time for the nodes that share a bucket alone, each from one of its ``rows``.
    """
    nodes = sketched.groupBy("node").agg(F.min(F.struct("doc_id", "a", "b", "fp")).alias("h"))

    def payload(asked: DataFrame) -> DataFrame:
        holder = nodes.join(asked, "node")
        on = (F.col("h.a") == F.col("a")) & (F.col("h.b") == F.col("b")) & F.col("h.doc_id").eqNullSafe(F.col("doc_id"))
        sets = rows.join(holder, on).select("node", F.col("h.fp").alias("fp"), "text").mapInArrow(_shingle_sets(shingle), "node long, fp long, shingles binary")
        return written(sets.dropDuplicates(["node"]))

    keyed = sketched.groupBy("node").agg(F.first("keys").alias("keys"), F.first("size").alias("weight")).select(F.explode("keys").alias("key"), "node", "weight")
    return bucket_components(keyed, payload, like_links(similarity), block)


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with all columns, one row of each group of like texts."""
    kind, text = docs.schema[id_col].dataType.simpleString(), text_of(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), content_key(text).alias("k")).select("doc_id", "text", "k.a", "k.b")
    sketched = written(rows.mapInArrow(_sketch(shingle), f"doc_id {kind}, a long, b long, node long, fp long, keys array<long>, size long"))
    roots = like_components(rows, sketched, shingle, similarity, block).withColumnRenamed("node", "of")
    placed = sketched.select("doc_id", F.struct("a", "b").alias("k"), "node").join(roots, F.col("node") == F.col("of"), "left")
    placed = placed.select("doc_id", "k", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k"))
    stays = placed.groupBy("root").agg(first.alias("w")).select(F.col("w.doc_id").alias("id"), F.col("w.k").alias("k"))
    count = placed.groupBy(F.col("doc_id").alias("of"), F.col("k").alias("k2")).agg(F.count(F.lit(1)).alias("rows"))
    winners = stays.join(count, F.col("id").eqNullSafe(F.col("of")) & (F.col("k") == F.col("k2"))).select("id", "k", "rows")
    return keep_rows(docs, winners, id_col, text_col)
