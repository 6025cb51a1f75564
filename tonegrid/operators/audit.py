"""Audit logs: JSON lines that each carry the hash of the line before; appended in order, verified in parallel.

A log that is appended to is a folder of numbered segments, each written once. A writer takes the hash of the last line and
claims the next number; whoever comes second finds it taken, and begins anew behind the first. So no two lines follow the same one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterable
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrid.sources.files import listed, qualified, store

FIELDS = ("timestamp", "actor", "action", "subject", "details", "prev_hash")


def entry_hash(entry: dict) -> str:
    """SHA-256 of the compact JSON, names in order, of all that a line says but its own hash and signature."""
    said = {f: entry.get(f, {} if f == "details" else "") for f in FIELDS}
    return hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def entry(actor: str, action: str, subject: str, details: dict | None = None, prev_hash: str = "", timestamp: str | None = None) -> dict:
    """The next line of a log."""
    made = {"timestamp": timestamp or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "actor": actor, "action": action, "subject": subject, "details": details or {}, "prev_hash": prev_hash}
    return made | {"entry_hash": entry_hash(made), "signature": None}


_SEGMENT = re.compile(r"/(\d{8})\.jsonl$")


def _segments(folder: str) -> list[tuple[int, str]]:
    """(number, path) of a log's segments, in order."""
    from pyarrow import fs

    at, local = store(folder)
    if at.get_file_info(local).type == fs.FileType.NotFound:
        return []
    return sorted((int(found[1]), path) for path, _ in listed(folder) if (found := _SEGMENT.search(path)))


def _claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call has made the file ``path``: false, and nothing is written, if there is one."""
    if path.startswith("file://"):
        local = path.removeprefix("file://")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        own = f"{os.path.dirname(local)}/_{uuid.uuid4().hex}"
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    from py4j.protocol import Py4JJavaError

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def append(spark: SparkSession, log: str, entries: Iterable[dict]) -> str:
    """Appends entries (actor, action, subject, details, timestamp) to a log as its next segment; returns the segment's path.

    What is said goes through the driver: an entry tells of an action, not of data.
    """
    folder, entries = qualified(spark, log).rstrip("/"), list(entries)
    while True:
        known = _segments(folder)
        number, last = known[-1][0] if known else 0, ""
        if known:
            at, local = store(known[-1][1])
            with at.open_input_stream(local) as f:
                last = json.loads(f.read().decode().rstrip("\n").rsplit("\n", 1)[-1])["entry_hash"]
        lines = []
        for said in entries:
            lines.append(entry(said["actor"], said["action"], said["subject"], said.get("details"), last, said.get("timestamp")))
            last = lines[-1]["entry_hash"]
        path = f"{folder}/{number + 1:08d}.jsonl"
        if _claimed(spark, path, "".join(json.dumps(x, sort_keys=True) + "\n" for x in lines)):
            return path


def read_segments(spark: SparkSession, log: str) -> DataFrame:
    """(log, line, text) of a log of segments; the number of a line's segment is in the upper 32 bits of ``line``."""
    lines = read_logs(spark, log)
    number = F.regexp_extract("log", _SEGMENT.pattern, 1)
    return lines.where(number != "").select(F.regexp_replace("log", _SEGMENT.pattern, "").alias("log"), (F.shiftleft(number.cast("long"), 32) + F.col("line")).alias("line"), "text")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(log, line, text) of all log files under ``path``; blank lines are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return whole.where(F.trim("text") != "")


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("prev_hash", "entry_hash", "recomputed")]))
def _hashes(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        try:
            line = json.loads(text)
            rows.append((line.get("prev_hash", ""), line.get("entry_hash", ""), entry_hash(line)))
        except (ValueError, AttributeError):
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["prev_hash", "entry_hash", "recomputed"])


def verify_logs(lines: DataFrame) -> DataFrame:
    """(log, line, problem) of (log, line, text): invalid JSON, a broken link to the last valid line, or a wrong hash."""
    read = lines.withColumn("h", _hashes("text")).select("log", "line", "h.*")
    before = F.last("entry_hash", ignorenulls=True).over(Window.partitionBy("log").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    checked = read.withColumn("before", F.coalesce(before, F.lit("")))
    problems = F.array_compact(F.array(
        F.when(F.col("recomputed").isNull(), "invalid JSON"),
        F.when(F.col("recomputed").isNotNull() & (F.col("prev_hash") != F.col("before")), "chain broken"),
        F.when(F.col("recomputed") != F.col("entry_hash"), "hash mismatch"),
    ))
    return checked.select("log", "line", F.explode(problems).alias("problem"))
