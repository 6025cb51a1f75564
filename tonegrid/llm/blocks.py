"""Components of nodes that are linked within shared buckets, of any size, exactly and without their pairs.

A linker compares the nodes of one unit of work and returns links that connect them, at most one fewer
than they are; pairs never leave it. Every pair of nodes that share a bucket is compared, unless both
are connected already:

1. Buckets with the same members are one bucket. A bucket is dealt into blocks of about ``block``
   nodes, and a few leaders go to all blocks, so that the large component of a bucket of like nodes
   is one after this round.
2. The nodes outside the bucket's largest component, in chunks of about ``block``, meet all blocks.

For n nodes of which r are outside that ships n * r / block rows: in proportion to n while a bucket hangs
together, and exact where it doesn't. A unit's rows are sorted next to each other and stream through a
task, which holds one unit at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.llm.common import written
from tonegrid.llm.components import components

#: Nodes of a block, and what a block of them weighs, on average, at most.
BLOCK, BLOCK_WEIGHT = 256, 1 << 20
#: Nodes of a bucket that round one compares with all its blocks, about.
LEADERS = 16

Linker = Callable[[pa.Table], list[tuple[int, int]]]


def unit_links(linker: Linker) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow``: links of the units (key, block, chunk), whose rows come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def flush() -> list[tuple[int, int]]:
            unit = pa.Table.from_batches(held)
            held.clear()
            return linker(unit) if unit.num_rows > 1 else []

        def given(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            unit = np.stack([batch[c].to_numpy() for c in ("key", "block", "chunk")])
            cuts = [0, *(np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            links = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if held and at != tuple(unit[:, a]):
                        links += flush()
                    at = tuple(unit[:, a])
                    held.append(batch.slice(a, b - a))
            yield given(links)
        if held:
            yield given(flush())

    return run


def partners(i: int, label: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which nodes the linker has to compare node ``i`` with: where ``rest`` is 0 the later ones, else 1s with 2s; none of its own label."""
    other = np.flatnonzero(label != label[i])
    return other[rest[other] == 2] if rest[i] == 1 else other[(other > i) & (rest[i] == 0)]


def joined(i: int, near: np.ndarray, nodes: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links of node ``i`` to those ``near`` it that it isn't connected with; updates ``label``."""
    out = []
    for j in near:
        if label[j] != label[i]:
            out.append((int(nodes[i]), int(nodes[j])))
            label[label == label[j]] = label[i]
    return out


def _compared(units: DataFrame, payload: DataFrame | None, linker: Linker) -> DataFrame:
    unit = ("key", "block", "chunk")
    rows = units if payload is None else units.join(payload.hint("merge"), "node")
    rows = rows.select(*unit, "node", "root", "rest", *[c for c in rows.columns if c not in (*unit, "node", "root", "rest")])
    rows = rows.repartition(*unit).sortWithinPartitions(*unit)
    return written(rows.mapInArrow(unit_links(linker), "u long, v long"))


def _dealt(keyed: DataFrame, block: int) -> DataFrame:
    members = [F.bit_xor(F.xxhash64(F.lit(salt), "node")).alias(name) for salt, name in ((1, "x1"), (2, "x2"))]
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), *members).where("n > 1")
    once = counts.groupBy("n", "x1", "x2").agg(F.min("key").alias("key"), F.first("weight").alias("total"))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("total") / BLOCK_WEIGHT))
    dealt = keyed.join(once.select("key", "n", blocks.alias("blocks")), "key")
    return written(dealt.withColumn("block", F.pmod(F.xxhash64("key", "node"), F.col("blocks"))))


def bucket_components(keyed: DataFrame, payload_of: Callable[[DataFrame], DataFrame] | None, linker: Linker, block: int = BLOCK) -> DataFrame:
    """(node, root) of all nodes with a link, from (key, node, weight), a row for each bucket that a node is in.

    ``payload_of`` is asked once, for the nodes that share a bucket at all, and gives what the linker
    needs of each; the unit that the linker gets also has node, root (what is connected already has one
    root) and rest (see :func:`partners`).
    """
    dealt = _dealt(keyed, block)
    payload = payload_of(dealt.select("node").distinct()) if payload_of else None
    leads = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit("lead"), "key", "node"), F.greatest(F.floor(F.col("n") / LEADERS), F.lit(1))) == 0)
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    first = dealt.select("key", F.explode(F.when(leads, every).otherwise(F.array("block"))).alias("block"), F.lit(0).cast("long").alias("chunk"), "node", F.col("node").alias("root"), F.lit(0).alias("rest"))
    roots = components(_compared(first, payload, linker))
    large = dealt.where("blocks > 1")
    if not large.limit(1).count():
        return roots
    placed = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    largest = F.struct("n", "root")
    main = counts.groupBy("key").agg(F.max_by("root", largest).alias("main"), (F.sum("n") - F.max("n")).alias("n"), (F.sum("weight") - F.max_by("weight", largest)).alias("weight"))
    chunks = F.ceil(F.greatest(F.col("n") / block, F.col("weight") / BLOCK_WEIGHT))
    placed = placed.select("key", "node", "root", "blocks", "block").join(main.where("n > 0").select("key", "main", chunks.alias("chunks")), "key")
    whole = placed.select("key", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "node", "root", F.lit(2).alias("rest"))
    rest = placed.where("root <> main").withColumn("chunk", F.pmod(F.xxhash64(F.lit("rest"), "key", "node"), F.col("chunks")))
    rest = rest.select("key", F.explode(every).alias("block"), "chunk", "node", "root", F.lit(1).alias("rest"))
    more = _compared(whole.unionByName(rest), payload, linker)
    return components(more.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
