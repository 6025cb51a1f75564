"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k edits. Cut it into k + 1 pieces: k edits cannot
touch them all, so every such occurrence holds one piece exactly. All pieces of a block of items
form one Aho-Corasick automaton that reads each whole text once; a piece's hit names the window where
its item must lie. Pieces are short, so most hits are chance: an edit spoils at most one of the
text's blocks of ``Q`` characters and ``Q`` of the item's runs of as many, and a window that holds less
than that leaves is discarded. Overlapping windows of
an item are joined, and Myers' bit-parallel distance verifies them. Texts never move: a pass over the documents is a map with a block of items.

The test set is read in blocks of at most ``BLOCK_CHARS`` characters (some ten thousand items). Each has a
job of its own over the documents, whose few hits are written before the next block is read, so driver
and executors hold one block at a time whatever the size of the test set.

Both sides are compared in lower case, with every run of characters other than letters and digits
as one blank. k is ``ERROR_RATE`` of m, rounded down, for items of any length. Items under ``WHOLE_WORDS``
characters are searched with a blank at either end, which is part of what may be edited: else short ones would be
found inside of longer words.

Defined results: null and empty texts match nothing, and null and empty items are in none; repeated items each report; repeated rows each report; texts of
any length are read whole; a null item_id stays null, and ids of any type keep it; an empty
table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm.common import content_key, table, text_of, written

ERROR_RATE, WHOLE_WORDS, Q = 0.1, 24, 4
BLOCK_CHARS = 4_000_000

_NOT_WORD = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    return _NOT_WORD.sub(" ", text.lower()).strip()


def budget(m: int, rate: float = ERROR_RATE) -> int:
    """Edits that an item of ``m`` characters may have."""
    return int(rate * m)


def pattern(item: str) -> str:
    """What is searched for a normalised item."""
    return item if len(item) >= WHOLE_WORDS else f" {item} "


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to any part of ``text``, where that part ends); (most + 1, -1) if above ``most``."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, best, at = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        rise, fall = (down | ~(diagonal | up)) & full, up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = (fall | ~(diagonal | rise)) & full, rise & diagonal
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """A block of test items, searched in one pass over a text."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(item_id, pattern(text), budget(len(text))) for item_id, text in items]
        self.grams = [{text[i : i + Q] for i in range(len(text) - Q + 1)} for _, text, _ in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By item: the joined windows in which it may lie, in order."""
        found: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                found.setdefault(n, set()).add(end + 1 - size - offset)
        out = {}
        for n, starts in found.items():
            _, item, k = self.items[n]
            joined: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - k), s + len(item) + 2 * k
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = b
                else:
                    joined.append([a, b])
            # the item fills at least m - k characters, and each edit spoils one block of them and Q runs of the item
            grams, blocks = self.grams[n], (len(item) - k - Q + 1) // Q - k
            runs = len(grams) - Q * k
            joined = [w for w in joined if sum([text[i : i + Q] in grams for i in range(w[0], min(w[1], len(text)), Q)]) >= blocks]
            joined = [w for w in joined if len(grams.intersection([text[i : i + Q] for i in range(w[0], min(w[1], len(text)) - Q + 1)])) >= runs]
            if joined:
                out[n] = joined
        return out

    def matches(self, raw: str) -> list[tuple[int, int]]:
        """(item_id, least distance) of the items that ``raw`` holds within their budgets."""
        text = normalise(raw)
        padded, out = f" {text} ", []
        for n, windows in self.windows(padded).items():
            item_id, item, k = self.items[n]
            whole = item[0] == " "
            near = [padded[a:b] if whole else text[max(0, a - 1) : b - 1] for a, b in windows]
            best = 0 if any(item in part for part in near) else min(myers(item, part, k)[0] for part in near)
            if best <= k:
                out.append((item_id, best))
        return sorted(out)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The searchable items, normalised, in blocks; the driver holds one at a time."""
    block, held = [], 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        item = normalise(text or "")
        if not item:
            continue
        if block and held + len(item) > block_chars:
            yield block
            block, held = [], 0
        block.append((item_id, item))
        held += len(item)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance): every document and test item it holds within the item's budget."""
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, distance int"
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") > 0)
    found = spark.createDataFrame([], schema)

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher([(n, text) for n, (_, text) in enumerate(shared.value)])
            ids = pa.array([item_id for item_id, _ in shared.value])
            for batch in batches:
                hits = [(i, n, d) for i, text in enumerate(batch["text"]) for n, d in matcher.matches(text.as_py())]
                at = [pa.array([h[c] for h in hits], pa.int64()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at[0]), ids.take(at[1]), at[2].cast(pa.int32())], ["doc_id", "item_id", "distance"])

        return run

    for block in item_blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(block)
        found = found.union(written(rows.mapInArrow(search(shared), schema)))
        shared.destroy()
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with all columns, without the documents that hold a test item.

    The last block filters the rows in place; texts that hold an item of a block before it are told by their hashes.
    """
    spark, blocks = docs.sparkSession, item_blocks(benchmark, block_chars)

    def holds(shared):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(shared.value)
            for texts in batches:
                yield pd.Series([bool(matcher.matches(t)) for t in texts], dtype=bool)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "boolean")(text_of(text_col))

    block, following = next(blocks, None), next(blocks, None)
    while following is not None:
        shared = spark.sparkContext.broadcast(block)
        bad = written(docs.where(holds(shared)).select(content_key(text_of(text_col)).alias("__tg_bad")).distinct())
        shared.destroy()
        docs = docs.join(bad, content_key(text_of(text_col)) == F.col("__tg_bad"), "left_anti")
        block, following = following, next(blocks, None)
    return docs if block is None else docs.where(~holds(spark.sparkContext.broadcast(block)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
