"""Exact dedup by a heavy-hitter split.

Misra-Gries (Spark's native ``freqItems``, which keeps every digest above ``support`` and at most
``1 / support`` of them) names the digests that a third of all rows may share. Their groups are
counted exactly with map-side combine, and the verified winners, at most ``1 / support`` rows, are
broadcast: rows of a heavy digest never move. All other digests take the ordinary shuffle, where
no group holds more than ``support`` of the rows.

Defined results: texts of any length are read whole; a null text counts as empty, so null, empty and all-blank texts are one group; of
equal lengths the smallest doc_id wins and null doc_ids lose; of identical rows exactly one stays;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm.common import content_key, keep_rows, no_spaces, table, text_of, written

#: A digest is heavy from this share of all rows; so at most 200 winners are broadcast.
SUPPORT = 0.005


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document, written once: the texts are read and hashed a single time."""
    text = text_of(text_col)
    return written(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            F.length(text).cast("long").alias("n"),
            F.sha2(no_spaces(text), 256).alias("digest"),
            content_key(text).alias("k"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def exact_groups(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``rows`` (of :func:`digests`) with keep_id, keep_row, group_size and kept."""
    order = F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))

    def winners(of: DataFrame) -> DataFrame:
        return of.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("w")).select(
            "digest", "group_size", F.col("w.doc_id").alias("keep_id"), F.col("w.row").alias("keep_row")
        )

    frequent = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    least = rows.count() * support
    heavy = written(winners(rows.join(F.broadcast(frequent), "digest", "left_semi")).where(F.col("group_size") >= least))
    hot = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return hot.unionByName(rest.join(winners(rest), "digest")).withColumn("kept", F.col("row") == F.col("keep_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts."""
    groups = exact_groups(digests(docs, id_col, text_col), support)
    same = groups.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept"))
    return keep_rows(docs, same.where("kept").select(F.col("doc_id").alias("id"), "k", "rows"), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(digests(table(spark, sf_dir, "documents")))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT text_sha256, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size
  FROM d GROUP BY text_sha256)
SELECT d.doc_id, w.keep_id, w.group_size, d.doc_id = w.keep_id AS kept, d.text_sha256
FROM d JOIN w USING (text_sha256)
"""
