"""Filter interaction audit: what each filter removes, at each place of every order of the filters.

All that matters of a document is which filters it fails: a mask. Documents are counted by (part, mask,
good, toxic), and from there on the work doesn't depend on how many there are. An array of all orders is
in the plan; each cell folds across it: ``transform`` over the orders, ``aggregate`` over the steps of one,
whose state is whether an earlier filter has removed the cell. That gives one struct for each order
and step, weighted by the cell's count; the structs of a part's cells are merged by elementwise sums.

Shuffled are one small row a document (part, id, SHA-256 of the text, mask), for the labels and for the
first holder of each text, and then cells. A text that a third of all documents hold is reduced to its smallest id
map-side; the join back is by (id, text), which no text can make hot.

Defined results: a null text is empty (it fails A alone of the conditions on texts); a null part is
the empty string, and one with it; a document with a null id is not after any other, so it passes E, nor do others
fail because of it; rows alike in id and text are documents of their own, none of them before the others; a
document with several labels is good (toxic) if any of them says so, without labels it is neither; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm.common import SPACE_CLASS, table, text_of, written

#: The filters, in the order of their bits. E is about the whole table, the others about a text.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (too short), B (too repetitive), C (too many capitals), D (holds a symbol)."""
    words = F.regexp_extract_all(text, F.lit("[^" + SPACE_CLASS[1:] + "+"), F.lit(0))
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > UPPER_PERCENT * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]


def failing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic): one row per row of ``docs``; bit i of the mask is set if it fails filter i."""
    text = text_of(f"`{text_col}`")
    four = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(text_failures(text))), F.lit(0))
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    rows = written(docs.select(F.col(f"`{id_col}`").alias("id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), four.cast("int").alias("mask")))
    firsts = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return (
        rows.join(firsts, ["id", "digest"], "left").select("id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))
        .join(marked.where("good OR toxic"), "id", "left")
        .select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    )


def _steps(cell: Column, order: Column) -> Column:
    """For one cell (mask, good, toxic, n) and one order (bits of its filters): a struct of counts for each step."""

    def step(state: Column, bit: Column) -> Column:
        fails, gone = cell["mask"].bitwiseAND(bit) != 0, state["gone"]
        here = fails & ~gone
        which = (~fails & ~gone, here, fails & gone, cell["mask"] == bit, here & cell["good"], here & cell["toxic"])
        counts = F.struct(*[F.when(w, cell["n"]).otherwise(F.lit(0).cast("long")).alias(c) for w, c in zip(which, COUNTS, strict=True)])
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(counts)).alias("steps"))

    kind = f"array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>"
    return F.aggregate(order, F.struct(F.lit(False).alias("gone"), F.array().cast(kind).alias("steps")), step)["steps"]


def interactions(rows: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from rows (part, mask, good, toxic).

    All orders of ``filters`` (at most six, 720 orders) are taken. A part has 4 * 2^filters cells at most, so what
    comes together in one row is bounded.
    """
    if not 0 < len(filters) <= 6 or any(len(f) != 1 for f in filters):
        raise ValueError("one to six filters, named by one character each")
    bits = {f: 1 << i for i, f in enumerate(filters)}
    every = list(permutations(filters))
    orders = F.array(*[F.array(*[F.lit(bits[f]) for f in order]) for order in every])
    cells = rows.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))

    def folded(cell: Column) -> Column:
        return F.flatten(F.transform(orders, lambda order: _steps(cell, order)))

    def summed(a: Column, b: Column) -> Column:
        return F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])

    none = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(every) * len(filters))
    merged = parts.select("part", F.aggregate("cells", none, lambda total, cell: F.zip_with(total, folded(cell), summed)).alias("steps"))
    removed_by = F.zip_with(F.flatten(orders), "steps", lambda bit, s: F.struct(bit.alias("bit"), s["removed"].alias("removed")))
    shapley = F.transform(
        F.array(*[F.lit(b) for b in bits.values()]),
        lambda own: F.aggregate("removed_by", F.lit(0).cast("long"), lambda total, r: total + F.when(r["bit"] == own, r["removed"]).otherwise(F.lit(0).cast("long"))),
    )
    totals = merged.withColumn("removed_by", removed_by).select("part", "steps", shapley.alias("shapley"))
    names, size = F.array(*[F.lit("".join(order)) for order in every]), len(filters)
    place, letter = F.col("pos"), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return (
        totals.select("part", "shapley", F.posexplode("steps").alias("pos", "s"))
        .select("part", "shapley", "s", F.element_at(names, (F.floor(place / size) + 1).cast("int")).alias("filter_order"), (place % size + 1).cast("int").alias("step"))
        .select("part", "filter_order", "step", letter.alias("filter"), *[F.col("s")[c].alias(c) for c in COUNTS], F.element_at("shapley", F.instr(F.lit("".join(filters)), letter)).alias("shapley"))
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The report of :func:`interactions` on the five filters of this module."""
    return interactions(failing(docs, labels, id_col, text_col, part_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT t.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order FROM f f1, f f2, f f3, f f4, f f5
  WHERE len(list_distinct([f1.x, f2.x, f3.x, f4.x, f5.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (
  SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
         CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n
  FROM d GROUP BY ALL),
w AS (
  SELECT *, contains(fails, letter) AS hit, fails <> '' AND len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AS gone
  FROM m, s),
r AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM w GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
