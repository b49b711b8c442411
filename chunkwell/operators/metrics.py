"""Counters and averages, and how they are kept and found again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(timed: DataFrame, by: str, seconds: str) -> DataFrame:
    """Total time and number of calls of each step."""
    return timed.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(seconds), 6).alias("seconds"))


def opcode_counters(commands: DataFrame, failed: Column) -> DataFrame:
    """Commands by opcode: how many came, and how many failed."""
    return commands.groupBy("opcode").agg(F.count(F.lit(1)).alias("commands"), F.count(F.when(failed, 1)).alias("errors"))


def timed_average(samples: DataFrame, by: str, at: str, value: str, now: Column, seconds: int) -> DataFrame:
    """Time-weighted average of a gauge over the last ``seconds`` before ``now`` (microseconds): each value counts for as long as it held within them.

    A gauge that was set before the window and not in it counts for the whole window; one that was only set after ``now`` has no average.
    """
    order = Window.partitionBy(by).orderBy(at)
    held = samples.where(F.col(at) < now).withColumn("_end", F.coalesce(F.lead(at).over(order), now))
    begin = F.greatest(F.col(at), now - seconds * 1_000_000)
    held = held.withColumn("_for", F.greatest(F.col("_end") - begin, F.lit(0))).where("_for > 0")
    return held.groupBy(by).agg(F.round(F.sum(F.col(value) * F.col("_for")) / F.sum("_for"), 6).alias("average"))


def persist(counters: DataFrame, prefix: str, path: str) -> None:
    """Counters (name, value) appended under prefixed keys; a later row of a key takes the place of an earlier one."""
    rows = counters.select(F.concat(F.lit(prefix + "."), "name").alias("key"), F.col("value").cast("long").alias("value"))
    rows.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def restore(spark, prefix: str, path: str) -> DataFrame:
    """The latest value of each counter (name, value) of a prefix."""
    rows = spark.read.parquet(path).where(F.startswith("key", F.lit(prefix + ".")))
    last = rows.groupBy("key").agg(F.max_by("value", "saved_at").alias("value"))
    return last.select(F.substr("key", F.lit(len(prefix) + 2)).alias("name"), "value")
