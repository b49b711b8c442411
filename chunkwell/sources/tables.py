"""Writes, blocks and the event log, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENT = 1 << 24  # address range of a request on its volume
SKEW = 1000  # requests begin off the block grid


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is one write request to volume 1."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("write_seq"), F.lit(1).alias("volume_id"), "source", (F.col("doc_id") * EXTENT + SKEW).alias("offset"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data")
    ).withColumn("size", F.octet_length("data").cast("long"))


def page_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is one write request to volume 2."""
    pages = read(spark, sf_dir, "pages")
    return pages.select(
        F.col("page_id").alias("write_seq"), F.lit(2).alias("volume_id"), F.lit("pages").alias("source"), (F.col("page_id") * EXTENT + SKEW).alias("offset"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("data")
    ).withColumn("size", F.octet_length("data").cast("long"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of count changes: the user is the fingerprint; purchases and signups add, errors take away, views and clicks change nothing."""
    delta = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), "event_type", F.col("user_id").alias("fp"), delta.cast("long").alias("delta"), (F.col("event_id") % 977).alias("block_id"), "ts", "value")
