"""Tables seen as signals: (channel, frame, x), one row per sample, and (vec_id, label, bin, mag), one row per spectral bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_signal(spark: SparkSession, sf_dir: str, channel: str = "user_id") -> DataFrame:
    """Each user's (or event type's) values in order of time."""
    in_time = Window.partitionBy(channel).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col(channel).alias("channel"), (F.row_number().over(in_time) - 1).cast("long").alias("frame"), F.col("value").alias("x")
    )


def stereo_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, frame, l, r): each user's samples in pairs, the even ones left and the odd ones right."""
    x = events_signal(spark, sf_dir)
    return (
        x.groupBy("channel", F.floor(F.col("frame") / 2).alias("frame"))
        .agg(F.max(F.when(F.col("frame") % 2 == 0, F.col("x"))).alias("l"), F.max(F.when(F.col("frame") % 2 == 1, F.col("x"))).alias("r"))
        .where("l IS NOT NULL AND r IS NOT NULL")
    )


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a spectral frame: bin and magnitude."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("bin", "v")).select(
        "vec_id", "label", F.col("bin").cast("long").alias("bin"), F.col("v").cast("double").alias("v"), F.abs(F.col("v").cast("double")).alias("mag")
    )


def order_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a supplier as a channel: quantities in order of order key, line and price."""
    rows = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_quantity", "l_shipdate", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("channel"), (F.row_number().over(rows) - 1).cast("long").alias("frame"), F.col("l_extendedprice").alias("x"))


#: The same views for the SQL of the queries.
SQL = {
    "sig": "sig AS (SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS x FROM events)",
    "typed": "typed AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame, value AS x FROM events)",
    "stereo": "stereo AS (SELECT * FROM (SELECT channel, frame // 2 AS frame, max(CASE WHEN frame % 2 = 0 THEN x END) AS l, max(CASE WHEN frame % 2 = 1 THEN x END) AS r FROM sig GROUP BY ALL) WHERE l IS NOT NULL AND r IS NOT NULL)",
    "spec": "spec AS (SELECT vec_id, label, CAST(i - 1 AS BIGINT) AS bin, CAST(embedding[i] AS DOUBLE) AS v, abs(CAST(embedding[i] AS DOUBLE)) AS mag FROM embeddings, range(1, 65) AS t(i))",
    "items": "items AS (SELECT l_suppkey AS channel, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_quantity, l_shipdate, l_discount, l_tax) - 1 AS frame, l_extendedprice AS x FROM lineitem)",
}


def views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
