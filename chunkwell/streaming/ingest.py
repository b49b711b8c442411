"""Writes and log events as streams, drained in micro-batches that may be repeated."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, dedup, mapping, volumes
from .replay import nothing_there, table

log = logging.getLogger(__name__)

INDEX = "fp string, first_seq long, first_no long, size long, usage_count long"


PREFIX = 1  # hex digits of a fingerprint that name a part of the index


def ingest(writes: DataFrame, folder: str, chunk_size: int, block_size: int, known_volumes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Drains a stream of writes; returns the chunk index and the block items. With ``known_volumes`` (volume_id, logical_size, maintenance) only
    requests that their volume takes are stored; the others go to ``folder``/refused with what they met.

    Each batch chunks its requests, adds the fingerprints that the index of earlier batches lacks, and its block items. All outputs
    of a batch lie under its number and replace themselves, so a batch repeated after a lost driver changes nothing; ``folder`` holds
    the position. The index lies in parts by the first digits of the fingerprint, and a batch reads the parts that it touches only.
    """
    spark = writes.sparkSession
    prefix = F.substring("fp", 1, PREFIX)

    def apply(batch: DataFrame, number: int) -> None:
        if known_volumes is not None:
            state = volumes.check_requests(batch, known_volumes)
            state.where("state <> 'ok'").write.mode("overwrite").parquet(f"{folder}/refused/batch={number}")
            batch = batch.join(state.where("state = 'ok'").select("volume_id", "write_seq"), ["volume_id", "write_seq"], "left_semi")
        chunks = chunking.static_chunks(batch, chunk_size)
        own = dedup.chunk_index(chunks).withColumn("prefix", prefix)
        known = table(spark, f"{folder}/index", f"{INDEX}, batch long, prefix string").where(F.col("batch") < number)
        if number:
            touched = [r[0] for r in own.select("prefix").distinct().collect()]  # 16 ** PREFIX strings at most
            known = known.where(F.col("prefix").isin(*touched))
        fresh = own.join(known.select("fp"), "fp", "left_anti")
        fresh.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{folder}/index/batch={number}")
        mapping.block_items(chunks, block_size).write.mode("overwrite").parquet(f"{folder}/items/batch={number}")

    query = writes.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/position").trigger(availableNow=True).start()
    query.awaitTermination()
    index = table(spark, f"{folder}/index", f"{INDEX}, batch long, prefix string")
    return index.drop("batch", "prefix"), spark.read.parquet(f"{folder}/items").drop("batch")


def publish(events: DataFrame, folder: str, consumers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Hands each batch of a stream of events to every consumer, and returns what each has made of the batches so far.

    Every consumer is a query with a position of its own. One that fails is named in the log, keeps its position and does not keep events from
    the others; the next call begins with the batch that it failed on, so it misses none.
    """
    spark, found = events.sparkSession, {}
    for name, consumer in consumers.items():

        def apply(batch: DataFrame, number: int, name: str = name, consumer: Callable = consumer) -> None:
            consumer(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

        query = events.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/position-{name}").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001  the consumers are independent
            log.exception("consumer %s stopped", name)
        try:
            found[name] = spark.read.parquet(f"{folder}/{name}")
        except Exception as ex:  # noqa: BLE001  failed on its first batch
            if not nothing_there(ex):
                raise
    return found


def staged(df: DataFrame, folder: str, key: str, files: int = 8) -> DataFrame:
    """A table as a stream of ``files`` files, a quarter of them a batch."""
    path = f"{folder}/staged-{uuid.uuid4().hex}"
    df.repartitionByRange(files, key).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // 4)).parquet(path)
