"""Helpers shared by the corpus operators: session settings, shared tables, row selection."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts, as a character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of our own, by application, where a session in local mode names none.
_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: one of our own in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master, app = spark.conf.get("spark.master", ""), spark.conf.get("spark.app.id", "")
    if not re.match(r"local($|\[)", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    if app not in _OWN_DIRS:
        own = tempfile.mkdtemp(prefix="tonegrid-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN_DIRS[app] = "file://" + own
    return _OWN_DIRS[app]


#: Paths of the tables written by this driver, in order, for :func:`discard`.
WRITTEN: list[str] = []


#: Spark then deletes the shuffle files of a job as it ends: what has been written needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tonegrid/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes what was written since ``WRITTEN`` was ``since`` long, but for the last ``keep`` tables: for callers whose results no longer read it."""
    jvm, gone = spark.sparkContext._jvm, WRITTEN[since : len(WRITTEN) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    WRITTEN[since : len(WRITTEN) - keep] = []


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def no_spaces(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def content_key(text: Column) -> Column:
    """128 bits of a text (two seeds of XXH64), for telling rows of one doc_id apart."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def pieces(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """``texts`` in slices of up to ``most`` bytes, or of one text."""
    import numpy as np
    import pyarrow.compute as pc

    upto, first = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + most, "right")))
        yield texts.slice(first, last - first)
        first = last


def keep_rows(docs: DataFrame, winners: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` named by ``winners`` (id, k = content_key of the raw text, rows = how often that pair occurs).

    One row stays for each winner. A pair that occurs once takes the semi-join; only repeated
    pairs are reduced by a grouping, so whole texts are grouped for those alone.
    """
    columns = docs.columns
    mine = docs.withColumn("__tg_k", content_key(text_of(text_col)))
    on = mine[id_col].eqNullSafe(F.col("__tg_id")) & (mine["__tg_k"] == F.col("__tg_w"))

    def named(w: DataFrame) -> DataFrame:
        return w.select(F.col("id").alias("__tg_id"), F.col("k").alias("__tg_w"))

    once = mine.join(named(winners.where("rows = 1")), on, "left_semi").select(*[F.col(f"`{c}`") for c in columns])
    repeated = (
        mine.join(named(winners.where("rows > 1")), on, "left_semi")
        .groupBy(F.col(f"`{id_col}`").alias("__tg_id"), F.col("__tg_k"))
        .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.lit(0)).alias("__tg_row"))
        .select(*[F.col("__tg_row").getField(c).alias(c) for c in columns])
    )
    return once.unionByName(repeated)
