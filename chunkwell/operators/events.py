"""The event log: numbering, runs of one type, fullness, idleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import last_marked, ranked

# Events that are stored; all others are only published.
PERSISTENT = frozenset(
    (
        "container_open", "container_commit_failed", "container_committed", "container_merged", "container_moved", "container_deleted", "block_mapping_written", "block_mapping_deleted",
        "block_mapping_write_failed", "orphan_chunks", "replay_started", "replay_stopped", "volume_attach", "volume_detach", "system_start",
    )
)
LOG_EMPTY = "log_empty"
KEYS = 1 << 16
LATENCY, THROUGHPUT = 512.0, 512.0 * 1024


def commit(events: DataFrame, last_log_id: int, order: str, persistent: Column | None = None) -> DataFrame:
    """Events with ``log_id``: persistent ones are numbered on from the last id in ``order``, without gaps; others have none and are published only."""
    stored = F.col("event_type").isin(*sorted(PERSISTENT)) if persistent is None else persistent
    rows = events.withColumn("_stored", stored)
    numbered = ranked(rows.where("_stored"), [order], F.floor(F.col(order) / KEYS)).withColumn("log_id", F.col("rank") + last_log_id).drop("rank", "_stored")
    return numbered.unionByName(rows.where("not _stored").drop("_stored").withColumn("log_id", F.lit(None).cast("long")))


def runs(log: DataFrame, number: int, position: int | None = None) -> DataFrame:
    """Events (log_id, event_type, ...) from the replay position on, with the ``batch`` a background replay takes each in: events of one type that follow each
    other, ``number`` of them at most. A batch is named by its first id. Ids are contiguous from the position on.
    """
    active = log if position is None else log.where(F.col("log_id") >= position)
    before = active.select((F.col("log_id") + 1).alias("log_id"), F.col("event_type").alias("_before"))
    rows = active.join(before, "log_id", "left")
    first = last_marked(rows, "log_id", F.col("_before").isNull() | (F.col("_before") != F.col("event_type")), KEYS, "_run")
    inside = F.col("log_id") - F.col("_run")
    return first.withColumn("batch", F.col("_run") + inside - F.pmod(inside, F.lit(number))).drop("_before", "_run")


def fullness(log_id: Column, replay_id: Column, limit: int, reserve: int = 0, nearly: int = 0, soft: float = 0.5, hard: float = 0.75) -> dict[str, Column]:
    """How full a log of ``limit`` places is with events from the replay id up to the next log id."""
    held = log_id - replay_id
    free = F.lit(limit) - held
    return {
        "free": free, "fill": F.round(held / limit, 6), "nearly_full": held + reserve >= limit - nearly,
        "soft_full": free < limit * (1 - soft), "hard_full": free < limit * (1 - hard),
    }


def idle(latency: Column, throughput: Column, forced_idle: Column | None = None, forced_busy: Column | None = None) -> Column:
    """Idle while both averages are low, or if forced; forced busy wins over all."""
    calm = (F.coalesce(latency, F.lit(0.0)) < LATENCY) & (F.coalesce(throughput, F.lit(0.0)) < THROUGHPUT)
    forced = F.coalesce(forced_idle, F.lit(False)) if forced_idle is not None else F.lit(False)
    busy = F.coalesce(forced_busy, F.lit(False)) if forced_busy is not None else F.lit(False)
    return (calm | forced) & ~busy
