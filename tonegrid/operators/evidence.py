"""Evidence: canonical JSON and fingerprints, redaction, hash chains, metadata completeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is redacted, in this order.
REDACTIONS = (
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[REDACTED:email]"),
    (r"\b(?:\d[ -]*?){11,16}\b", "[REDACTED:card]"),
    (r"/(?:home|Users)/[^/]+", "[REDACTED:userpath]"),
)


def redact(text: Column) -> Column:
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark.replace("$", r"\$"))
    return text


def json_string(text: Column) -> Column:
    """A JSON string of a text, as ASCII with the short escapes only where the text holds nothing else to escape."""
    for char, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), text, F.lit('"'))


def canonical(*fields: tuple[str, Column]) -> Column:
    """A compact JSON object of (name, JSON text) fields, names in order; null fields are ``null``."""
    parts = [F.concat(F.lit(f'"{n}":'), F.coalesce(c, F.lit("null"))) for n, c in sorted(fields, key=lambda f: f[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fingerprints(findings: DataFrame, *keys: str) -> DataFrame:
    """(keys, findings, fingerprint): SHA-256 of the canonical list of a subject's findings, sorted by analyzer and metric."""
    one = canonical(
        ("analyzer", json_string(F.col("analyzer"))), ("metric", json_string(F.col("metric"))), ("status", json_string(F.col("status"))),
        ("value", F.format_string("%.6f", F.col("value"))),
    )
    listed = findings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("analyzer", "metric", one.alias("j")))).alias("l"))
    whole = F.concat(F.lit("["), F.array_join(F.transform("l", lambda s: s["j"]), ","), F.lit("]"))
    return listed.select(*keys, F.size("l").cast("long").alias("findings"), F.sha2(whole, 256).alias("fingerprint"))


def entry_hash(payload: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", payload, previous), 256)


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (log, line, payload) sorted by log and line: adds prev_hash and entry_hash. Lines stream through; only the last hash is held."""
    log, last = None, ""
    for batch in batches:
        before, own = [], []
        for of, payload in zip(batch["log"].to_pylist(), batch["payload"].to_pylist(), strict=True):
            if of != log:
                log, last = of, ""
            before.append(last)
            last = hashlib.sha256("|".join(x for x in (payload, last) if x is not None).encode()).hexdigest()
            own.append(last)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], [*batch.schema.names, "prev_hash", "entry_hash"])


def verify_chain(entries: DataFrame, payload: Column) -> DataFrame:
    """(log, entries, broken_links, bad_hashes, valid) of (log, line, prev_hash, entry_hash) logs.

    Every line is checked against the one before it by a window, so logs verify in parallel.
    """
    in_order = Window.partitionBy("log").orderBy("line")
    linked = entries.withColumn("before", F.coalesce(F.lag("entry_hash").over(in_order), F.lit("")))
    checked = linked.select("log", (F.col("before") != F.col("prev_hash")).alias("broken"), (entry_hash(payload, F.col("prev_hash")) != F.col("entry_hash")).alias("bad"))
    counts = checked.groupBy("log").agg(F.count(F.lit(1)).alias("entries"), F.count_if("broken").alias("broken_links"), F.count_if("bad").alias("bad_hashes"))
    return counts.withColumn("valid", (F.col("broken_links") == 0) & (F.col("bad_hashes") == 0))


def completeness(present: dict[str, Column], *keys: Column) -> list[Column]:
    """Columns completeness (share of fields that are there) and missing (their names, in order)."""
    names = [F.when(~F.coalesce(there, F.lit(False)), n) for n, there in present.items()]
    missing = F.array_compact(F.array(*names))
    return [F.round(1 - F.size(missing) / F.lit(float(len(present))), 4).alias("completeness"), F.array_join(missing, ",").alias("missing")]
