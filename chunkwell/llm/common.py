"""Helpers that the training-data operators share."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from operator import add

from pyarrow import fs
from pyspark.errors import AnalysisException

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Lets Spark remove the shuffle files of a query when the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: White space of the word and normalisation rules, as a Java character class and as plain characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local run gets a temporary one; a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="chunkwell-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where


def save(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back; the shuffle files that it took go at once."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    if before is not None:  # older versions do not know it
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends at files that outlive any executor."""
    return save(df, f"{shared_dir(df.sparkSession)}/chunkwell/{name}-{uuid.uuid4().hex}")


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more. A folder that cannot be reached from here is left to whoever cleans the shared one."""
    for df in tables:
        folder = df.inputFiles()
        if not folder:
            continue
        path = folder[0].rpartition("/")[0]
        if "/chunkwell/" not in path:
            raise ValueError(f"not a table of ours: {path}")
        try:
            store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))
            store.delete_dir(inner)
        except (OSError, ValueError) as ex:
            log.info("%s stays: %s", path, ex)


def first_rows(docs: DataFrame, digest: Column, kept: DataFrame) -> DataFrame:
    """One row, with all its columns as they are, for each (id, sha) of ``kept``: of the rows with that doc_id, null or not, and that ``digest`` of their text."""
    # The row travels as one value, so that no column of it can clash with those used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc"), digest.alias("digest"))
    got = rows.join(kept.hint("merge"), F.col("doc").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc", "digest").orderBy(F.lit(0)))  # rows that are equal in both
    return got.withColumn("nth", nth).where("nth = 1").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads; where it is not read from files, the bytes of its strings, counted, and 8 for each other value."""
    try:
        files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).groupBy("path").agg(F.max("size").alias("size"))
        return int(files.agg(F.sum("size")).first()[0] or 0)
    except AnalysisException:
        widths = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in df.schema]
        return int(df.agg(F.sum(reduce(add, widths).cast("long"))).first()[0] or 0)


def parts(df: DataFrame, mb: float, least: int | None = None) -> int:
    """So many partitions that each gets about ``mb`` MB of ``df``."""
    least = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, int(input_bytes(df) / (mb * 1e6)) + 1))


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """``df``, aggregated by the number ``key``, as the side of a join: computed once more, the key is dealt out once more, and Spark splits a large partition only of what was dealt out for the join itself."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long"))).hint("merge")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of each node of ``edges`` (a, b): the smallest node of its connected component.

    Minimum labels spread over the edges, then each label takes the label of its own node (pointer jumping), until none
    changes; one flag a round comes to the driver. Aggregates are partial and the joins can be split, so hubs do no harm; they are
    merged at every size, so no table goes through the driver. A round's tables are deleted once the next has been written.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        seen = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        nearer = labels.join(seen.hint("merge"), labels["node"] == seen["a"]).select("node", F.least("label", "low").alias("label"), F.col("label").alias("old"))
        nearer = written(nearer, f"{name}-near")
        own = nearer.select(F.col("node").alias("via"), F.col("label").alias("to"))
        after = written(nearer.join(own.hint("merge"), nearer["label"] == own["via"]).select("node", F.col("to").alias("label"), (F.col("to") != F.col("old")).alias("moved")), f"{name}-labels")
        discard(nearer, labels)
        labels = after
        if not labels.agg(F.coalesce(F.max("moved"), F.lit(False))).first()[0]:
            discard(both)
            return labels.select("node", "label")
