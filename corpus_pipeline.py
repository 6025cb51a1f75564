"""Corpus pipeline: from raw documents to a mixed training set, one operator after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read back as the next one's docs. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm import decontaminate as decontamination
from tonegrid.llm import exact_dedup as exact
from tonegrid.llm import mixing, near_dedup, quality
from tonegrid.llm.common import WRITTEN, discard, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labels outside its held-out fold, doesn't reject."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 or more on shingles of five words."""
    return near_dedup.near_dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item within its edit budget."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents it takes, with whole repetitions, words of a partial one, and words taken in all."""
    plan = mixing.mix(mixing.sizes(docs))
    return plan.where("taken > 0").select("doc_id", "source", "size", F.col("whole").alias("repetitions"), F.col("part").alias("part_words"), "target", "taken")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: The classifier, shingle hashes and edit distances are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's tables are deleted once its result is written; the last stage's stay, as its result reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        since = len(WRITTEN)
        docs = written(stage(spark, docs, sf_dir))
        discard(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
