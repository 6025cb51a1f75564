"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated ``max_epochs`` times at most. The budget is shared by
weight; a source whose share is above its cap is clamped there and the excess goes to the others in
proportion, until no share is above its cap. Sorting sources by cap / weight makes that one pass of
running sums: the clamped ones are a prefix of that order. The work on sources is over one row each.

A source then takes ``quota`` = its target in whole words: each document as many whole times as the
source fits into its quota, and the remainder as a fractional repetition: documents in the order of
a seeded MD5 of their doc_id until the remainder is used up, the last of them in part. Running sums
go over hash buckets first (a source of any size becomes ``BUCKETS`` rows), then within a bucket.

Defined results: texts of any length are read whole; repeated rows are documents of their own; null and empty texts have size 0 and take nothing; the null source is a source of
its own and comes last; a source of size 0 has target 0; equal hashes order by doc_id, then size; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonegrid.llm.common import SPACE_CLASS, content_key, table, text_of, written

MAX_EPOCHS, WEIGHTS, SEED = 3, (1, 2, 3), 17
#: The first three hexadecimal digits of the order key.
BUCKETS = 16**3


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One small row per document: its words and its place in the seeded order."""
    text, doc = text_of(text_col), F.col(f"`{id_col}`")
    return written(
        docs.select(
            doc.alias("doc_id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            F.regexp_count(text, F.lit("[^" + SPACE_CLASS[1:] + "+")).cast("long").alias("size"),
            F.md5(F.concat_ws(":", F.lit(str(seed)), doc.cast("string"))).alias("place"),
            content_key(text).alias("k"),
        )
    )


def water_fill(sources: DataFrame, max_epochs: int, share: float = 1.0) -> DataFrame:
    """``sources`` (source, weight, size) with target: ``share`` of all sizes, capped at ``max_epochs`` times each size."""
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source")
    running = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("cap", F.col("size") * max_epochs)
        .withColumn("total", F.sum("size").over(everything) * F.lit(share))
        .withColumn("free", F.col("total") - (F.sum("cap").over(running) - F.col("cap")))
        .withColumn("weights", F.sum("weight").over(everything) - (F.sum("weight").over(running) - F.col("weight")))
        .withColumn("level", F.col("free") / F.col("weights"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("water", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(everything)["level"])
    )
    flowing = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")))
    return ranked.withColumn("target", flowing.cast("double"))


def mix(rows: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple = WEIGHTS, share: float = 1.0) -> DataFrame:
    """``rows`` (of :func:`sizes`) with source_size, target, whole (repetitions), part (words of one more) and taken."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = (
        rows.groupBy("source").agg(F.sum("size").alias("size"))
        .withColumn("weight", F.element_at(cycle, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
    )
    plan = water_fill(sources, max_epochs, share).select(
        "source", F.col("size").alias("source_size"), "target",
        F.least(F.round("target").cast("long"), F.col("cap")).alias("quota"),
    )
    split = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long"))
    split = split.withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size"))
    placed = rows.withColumn("bucket", F.substring("place", 1, 3))
    starts = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = starts.withColumn("start", F.sum("bucket_size").over(before) - F.col("bucket_size"))
    starts = starts.join(split.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "bucket_size")
    starts = starts.withColumnsRenamed({"source": "of", "bucket": "of_bucket"})
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.withColumn("upto", F.sum("size").over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("of_bucket")))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("upto") + F.col("size"))).cast("long"))
        .withColumn("taken", F.col("size") * F.col("whole") + F.col("part"))
        .select("doc_id", "source", "size", "k", "source_size", "target", "whole", "part", "taken")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sizes(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('17:' || CAST(doc_id AS VARCHAR)) AS place,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size, 3 * CAST(sum(size) AS BIGINT) AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, CAST(sum(size) OVER () AS DOUBLE) - CAST(sum(cap) OVER o - cap AS DOUBLE) AS free,
         CAST(sum(weight) OVER () - (sum(weight) OVER o - weight) AS DOUBLE) AS weights, cap / weight AS turn
  FROM s WINDOW o AS (ORDER BY cap / weight, source ROWS UNBOUNDED PRECEDING)),
w AS (SELECT first(free / weights ORDER BY turn, source) AS water FROM r WHERE free / weights * weight <= cap),
q AS (
  SELECT source, size AS source_size, CASE WHEN water IS NULL THEN cap ELSE least(CAST(cap AS DOUBLE), water * weight) END AS target, cap
  FROM r, w),
p AS (SELECT *, least(CAST(round(target) AS BIGINT), cap) AS quota FROM q),
x AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.quota // greatest(p.source_size, 1) AS whole, p.quota,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * whole + greatest(0, least(size, quota - whole * source_size - before)) AS BIGINT) AS taken
FROM x
"""
