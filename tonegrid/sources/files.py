"""Paths as Spark takes them, for readers and writers that run in Python workers."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, as Spark's own readers resolve it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def store(path: str):
    """(file system, path on it) of a qualified or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, glob: str = "*") -> list[tuple[str, int]]:
    """(path, size) of the files under a folder, or of one file, by name; hidden ones are left out, as Spark does."""
    from pyarrow import fs

    at, local = store(path)
    root = path[: len(path) - len(local)] if path.endswith(local) else ""
    info = at.get_file_info(local)
    found = [info] if info.type == fs.FileType.File else at.get_file_info(fs.FileSelector(local, recursive=True))
    shown = (f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and fnmatch(f.base_name, glob))
    return sorted((root + f.path, f.size) for f in shown)
