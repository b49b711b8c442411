"""Ranks and running values over a whole table, without a window over all its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: Sequence[str], bucket: Column, name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row in ``order``.

    ``bucket`` is a coarse form of the first column of the order: it may only grow with it. Rows are ranked within buckets, and buckets are
    summed up in a window that has one row a bucket.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return own.join(before, "_bucket").withColumn(name, F.col("_own") + F.col("_before")).drop("_bucket", "_own", "_before")


def last_marked(df: DataFrame, key: str, marked: Column, bucket: int, name: str) -> DataFrame:
    """``df`` with the greatest ``key``, at or before each row's own, of a marked row; keys are integers and distinct.

    Looked for within buckets of ``bucket`` keys; rows before their bucket's first marked one take the last of an earlier bucket.
    """
    rows = df.withColumn("_at", F.when(marked, F.col(key))).withColumn("_bucket", F.floor(F.col(key) / bucket))
    within = Window.partitionBy("_bucket").orderBy(key)
    rows = rows.withColumn("_in", F.last("_at", ignorenulls=True).over(within))
    ends = rows.groupBy("_bucket").agg(F.max("_at").alias("_end"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    return rows.join(carried, "_bucket").withColumn(name, F.coalesce("_in", "_carried")).drop("_at", "_in", "_bucket", "_carried")
