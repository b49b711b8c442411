"""The log as a stream: it is only ever appended to, and every consumer has its own position in it."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events

log = logging.getLogger(__name__)


def nothing_there(ex: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(ex) or "UNABLE_TO_INFER_SCHEMA" in str(ex)


def table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files, empty if nothing was written yet."""
    try:
        spark.read.parquet(path)
    except Exception as ex:  # noqa: BLE001
        if not nothing_there(ex):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


class EventLog:
    """An append-only log in a folder, with a replay position for each consumer.

    A commit appends a segment of its own; no file that was written is written again, so a consumer that reads it as a stream sees every event
    once. Positions are rows that are appended too: the last one holds.
    """

    def __init__(self, spark: SparkSession, folder: str, schema):
        self.spark, self.folder, self.schema = spark, folder, schema

    def read(self) -> DataFrame:
        return table(self.spark, f"{self.folder}/log", self.schema)

    def last_id(self) -> int:
        return self.read().agg(F.max("log_id")).first()[0] or 0

    def commit(self, new: DataFrame, order: str, persistent=None, files: int = 4) -> None:
        """Appends events (event_type, ...) in ``order`` behind the last id."""
        rows = events.commit(new, self.last_id(), order, persistent).where("log_id is not null")
        rows.select(*self.read().columns).repartitionByRange(files, "log_id").write.mode("append").parquet(f"{self.folder}/log")

    def append(self, rows: DataFrame, files: int = 4) -> None:
        """Appends events that have their ids already, as far as the log does not hold them."""
        held = self.read().agg(F.max("log_id")).first()[0]
        fresh = rows if held is None else rows.where(F.col("log_id") > held)
        if not fresh.isEmpty():
            fresh.select(*self.read().columns).repartitionByRange(files, "log_id").write.mode("append").parquet(f"{self.folder}/log")

    def position(self, consumer: str) -> int:
        """The next id that a consumer has to replay."""
        rows = table(self.spark, f"{self.folder}/positions/{consumer}", "next_id long")
        return rows.agg(F.max("next_id")).first()[0] or 1

    def _advance(self, consumer: str, next_id: int) -> None:
        self.spark.createDataFrame([(next_id,)], "next_id long").coalesce(1).write.mode("append").parquet(f"{self.folder}/positions/{consumer}")

    def background(self, consumers: Mapping[str, Callable[[DataFrame], DataFrame]], number: int = 4096) -> dict[str, str]:
        """Replays the open range to every consumer, each from its own position, in batches of one event type; returns what became of each.

        A consumer gets the events with their ``batch`` and gives rows, which are stored under its first id before its position moves on: one that is stopped
        in between does that range again and replaces what it left. A consumer that fails keeps its position and does not hold up the others.
        """
        found, end = {}, self.last_id()
        for name, consumer in consumers.items():
            begin = self.position(name)
            if begin > end:
                found[name] = "empty"
                continue
            try:
                open_range = events.runs(self.read().where(F.col("log_id") <= end), number, begin)
                consumer(open_range).write.mode("overwrite").parquet(f"{self.folder}/results/{name}/from={begin}")
                self._advance(name, end + 1)
                found[name] = "done"
            except Exception:  # noqa: BLE001  the consumers are independent
                log.exception("consumer %s failed from %d on", name, begin)
                found[name] = "failed"
        return found

    def results(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/results/{name}").drop("from")

    def dirty(self, name: str, consumer: Callable[[DataFrame], DataFrame], number: int = 4096) -> DataFrame:
        """What a consumer makes of its open range after a crash; its position stays, so that the background replay still runs."""
        return consumer(events.runs(self.read(), number, self.position(name)))

    def note_empty(self, name: str) -> bool:
        """Appends a log-empty event once a consumer has caught up, unless the last event is one already."""
        end = self.last_id()
        if self.position(name) <= end or not end:
            return False
        last = self.read().where(F.col("log_id") == end).select("event_type").first()[0]
        if last == events.LOG_EMPTY:
            return False
        row = self.spark.range(1).select(F.lit(end + 1).cast("long").alias("log_id"), F.lit(events.LOG_EMPTY).alias("event_type"))
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.read().schema if f.name not in row.columns]
        row.select("*", *blank).select(*self.read().columns).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        self._advance(name, end + 2)
        return True


def replay_counts(spark: SparkSession, changes: DataFrame, folder: str, name: str | None = None, files: int = 8) -> DataFrame:
    """Usage counts by draining a log (log_id, fp, delta) in micro-batches, each (log_id, fp) once; the checkpoint is the replay position.

    A call under the same name appends the events that the log lacks and goes on from the checkpoint, so what was replayed is not read again; each batch writes
    its partial rows under its own number, so a repeated batch replaces itself.
    """
    name = name or uuid.uuid4().hex
    base = f"{folder}/replay-{name}"
    EventLog(spark, base, changes.schema).append(changes, files)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", max(1, files // 4)).parquet(f"{base}/log")

    def apply(batch: DataFrame, number: int) -> None:
        batch.groupBy("log_id", "fp").agg(F.max("delta").alias("delta")).write.mode("overwrite").parquet(f"{base}/batches/batch={number}")

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{base}/position").trigger(availableNow=True).start()
    query.awaitTermination()
    once = spark.read.parquet(f"{base}/batches").groupBy("log_id", "fp").agg(F.max("delta").alias("delta"))
    return once.groupBy("fp").agg(F.sum("delta").alias("usage_count"))
