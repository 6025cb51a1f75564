"""Line dedup: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble.

Every distinct key of a document becomes one (row, 128-bit hash) pair, so counting pairs counts
documents; the count combines map-side and a line that all documents share costs one row per task.
Pairs of frequent keys go back to their document as its drop list, which joins the texts once.

Defined results: texts of any length are read whole; each row is a document of its own; null and empty texts are one empty line, which
stays; a key is the line stripped of white space with A-Z lowered; keys shorter than ``min_chars``
code points never drop; a document that loses every line becomes the empty text; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm.common import table, text_of, written

MIN_DOCS, MIN_CHARS = 10, 1
#: Frequent keys up to this count (some 20 MB) are broadcast; beyond it the pairs are shuffled to them.
BROADCAST_KEYS = 250_000


def line_keys(text: bytes, min_chars: int) -> list[tuple[bytes, bytes | None]]:
    """(line, key hash) in order; no hash for keys that are too short. ASCII rules are those of bytes."""
    from xxhash import xxh3_128_digest

    out = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        long_enough = len(key) >= min_chars if min_chars <= 1 else len(key.decode()) >= min_chars
        out.append((line, xxh3_128_digest(key) if long_enough else None))
    return out


def _pairs(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for row, text in zip(batch["row"].to_pylist(), batch["text"], strict=True):
                own = {k for _, k in line_keys(text.as_buffer().to_pybytes(), min_chars) if k is not None}
                keys.extend(own)
                rows.extend([row] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.binary())], ["row", "key"])

    return run


def _kept(min_chars: int):
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, texts, digests = [], [], [], []
            for text, drop in zip(batch["text"], batch["drop"].to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                if drop:
                    own, gone = line_keys(raw, min_chars), set(drop)
                    stay = [line for line, k in own if k not in gone]
                    n, kept = len(own), b"\n".join(stay)
                    dropped.append(n - len(stay))
                else:
                    n, kept = raw.count(b"\n") + 1, raw
                    dropped.append(0)
                lines.append(n)
                texts.append(kept.decode())
                digests.append(sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"],
            )

    return run


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, kept_text: one row per row of ``docs``.

    ``row`` is a hash of (doc_id, text): rows alike in both have the same lines and so one drop list.
    """
    text, doc = text_of(text_col), F.col(f"`{id_col}`")
    rows = docs.select(doc.alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(7), doc, text).alias("row"))
    pairs = rows.select("row", "text").mapInArrow(_pairs(min_chars), "row long, key binary")
    frequent = written(pairs.groupBy("key").count().where(F.col("count") >= min_docs).select("key"))
    if frequent.count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)
    drops = pairs.join(frequent, "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("drop"))
    found = rows.join(drops, "row", "left").select("doc_id", "text", "drop")
    return found.mapInArrow(_kept(min_chars), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""
