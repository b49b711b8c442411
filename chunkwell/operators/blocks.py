"""Blocks as they live: stored, read, deleted and failed in two tiers, and what a replay of their events does by its mode.

Mappings are rows of items (block_id, version, pos, fp, data_address, chunk_offset, size); tiers are rows (block_id, version, event_log_id).
An event log id of 0 says that a version is still volatile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EMPTY_FP
from . import mapping
from .ranking import ranked

RANKED = 1 << 20


def store_blocks(previous: DataFrame, updated: DataFrame, main: DataFrame, capacity: int, last_log_id: int) -> DataFrame:
    """previous and updated (block_id, version, fp, data_address), main (block_id, version) -> one written event for each block of ``updated``.

    A block that has no version yet is new; new blocks are taken, in order of their ids, while the main tier has room, the others are
    refused as full. A written event has the block's next version, a log id, the containers that its commit waits for and the fingerprints of the
    previous version, which no collection may touch until the event is replayed.
    """
    old = previous.groupBy("block_id").agg(F.max("version").alias("old_version"), F.array_sort(F.collect_set(F.when(F.col("fp") != EMPTY_FP, F.col("fp")))).alias("in_combat"))
    new = updated.groupBy("block_id").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("data_address").alias("containers"))
    both = new.join(old, "block_id", "left").select("block_id", (F.coalesce("old_version", F.lit(0)) + 1).cast("long").alias("version"), "items", "containers", F.coalesce(F.size("in_combat"), F.lit(0)).cast("long").alias("in_combat"))
    fresh = ranked(both.where("version = 1").select("block_id"), ["block_id"], F.floor(F.col("block_id") / RANKED), "nth")
    room = main.agg((F.lit(capacity) - F.count(F.lit(1))).alias("room"))  # one row
    refused = fresh.join(F.broadcast(room), F.col("nth") > F.col("room"), "left_semi").select("block_id", F.lit(True).alias("full"))
    said = both.join(refused, "block_id", "left").withColumn("state", F.when(F.col("full"), "full").otherwise("written")).drop("full")
    taken = ranked(said.where("state = 'written'").select("block_id"), ["block_id"], F.floor(F.col("block_id") / RANKED)).select("block_id", (F.col("rank") + last_log_id).alias("log_id"))
    return said.join(taken, "block_id", "left").select("block_id", "version", "state", "log_id", "items", "containers", "in_combat")


def read_blocks(asked: DataFrame, session: DataFrame, aux: DataFrame, main: DataFrame, block_size: int) -> DataFrame:
    """Items of the blocks asked for: those that the session still holds open, else the auxiliary tier's, else the main tier's, zeros elsewhere.

    A tier hides whole blocks of the ones behind it, not single items.
    """
    def of(tier: DataFrame, *before: DataFrame) -> DataFrame:
        rows = tier.select(*mapping.ITEM)
        for b in before:
            rows = rows.join(b.select("block_id").distinct(), "block_id", "left_anti")
        return rows

    held = of(session).unionByName(of(aux, session)).unionByName(of(main, session, aux))
    return mapping.fill_empty(asked, held, block_size)


def delete_blocks(asked: DataFrame, main: DataFrame, aux: DataFrame, volatile: DataFrame) -> DataFrame:
    """asked (block_id), tiers (block_id, fp) -> (block_id, outcome, fp, delta): a volatile block is refused, one that no tier has is not found.

    A deleted block's items give back their uses; of a block in both tiers the auxiliary one counts, and both are removed.
    """
    ids = asked.select("block_id").distinct()
    held = aux.select("block_id", "fp").unionByName(main.select("block_id", "fp").join(aux.select("block_id").distinct(), "block_id", "left_anti"))
    uses = held.where(F.col("fp") != EMPTY_FP).groupBy("block_id", "fp").agg((-F.count(F.lit(1))).alias("delta"))
    known = held.select("block_id", F.lit(True).alias("known")).distinct()
    busy = volatile.select("block_id", F.lit(True).alias("busy")).distinct()
    said = ids.join(busy, "block_id", "left").join(known, "block_id", "left")
    said = said.select("block_id", F.when(F.col("busy"), "volatile").when(F.col("known"), "deleted").otherwise("not_found").alias("outcome"))
    gone = said.where("outcome = 'deleted'").join(uses, "block_id", "left")
    return gone.unionByName(said.where("outcome <> 'deleted'").select("block_id", "outcome", F.lit(None).cast("string").alias("fp"), F.lit(None).cast("long").alias("delta")))


def fail_writes(failed: DataFrame, aux: DataFrame, main: DataFrame) -> DataFrame:
    """failed (block_id, version, write_log_id), tiers (block_id, version, data_version) -> the auxiliary rows (block_id, version, event_log_id,
    data_version) that failed writes leave behind: the failed version's number, over the data of the version before.

    A row is only replaced where the tiers still hold the failed version, or know nothing of the block; a later version stays as it is.
    """
    a = aux.select("block_id", F.col("version").alias("a"))
    m = main.select("block_id", F.col("version").alias("m"))
    both = failed.join(a, "block_id", "left").join(m, "block_id", "left")
    hit = F.when(F.col("a").isNotNull(), F.col("a") == F.col("version")).otherwise(F.col("m").isNull() | (F.col("m") == F.col("version")))
    return both.where(hit).select("block_id", "version", F.col("write_log_id").alias("event_log_id"), (F.col("version") - 1).alias("data_version"))


DIRECT, DIRTY, BACKGROUND = "direct", "dirty", "background"


def replay_written(events: DataFrame, main: DataFrame, aux: DataFrame, failed: DataFrame, uncommitted: DataFrame, mode: str) -> DataFrame:
    """What becomes of written events (log_id, block_id, version), each judged against the tiers as they are.

    main (block_id, version), aux (block_id, version, event_log_id), failed (block_id, version), uncommitted (block_id, version): versions
    with a container that was never committed.

    direct: nothing, the auxiliary tier has it already. dirty: the version becomes volatile again if it is newer than main's and not known as failed; an
    auxiliary version of a later event is an error. background: it moves to main if it is newer, unless the block was deleted, the version is known
    as failed, or a container is missing, in which case a failure event is written. If the auxiliary tier has a later version that is not volatile any more,
    that one is imported at once; a volatile one stays behind.
    """
    if mode == DIRECT:
        return events.select("log_id", "block_id", "version", F.lit("ignore").alias("action"), F.lit(None).cast("long").alias("import_version"))
    key = ["block_id", "version"]
    flag = lambda df, name: df.select(*key, F.lit(True).alias(name)).distinct()
    rows = events.join(main.select("block_id", F.col("version").alias("m")), "block_id", "left")
    rows = rows.join(aux.select("block_id", F.col("version").alias("a"), F.col("event_log_id").alias("a_log")), "block_id", "left")
    rows = rows.join(flag(failed, "broken"), key, "left").join(flag(uncommitted, "open"), key, "left")
    old = F.col("m").isNotNull() & (F.col("m") >= F.col("version"))
    if mode == DIRTY:
        wrong = F.col("a").isNotNull() & (F.col("a_log") >= F.col("log_id"))
        action = F.when(wrong, "error").when(old, "skip_old").when(F.col("broken"), "skip_failed").otherwise("volatile")
        return rows.select("log_id", *key, action.alias("action"), F.lit(None).cast("long").alias("import_version"))
    if mode != BACKGROUND:
        raise ValueError(f"no replay mode {mode}")
    later = F.col("a") > F.col("version")
    action = (
        F.when(F.col("a").isNull(), "skip_deleted").when(old, "skip_old").when(F.col("broken"), "skip_failed").when(F.col("open"), "mark_failed")
        .when(later & (F.col("a_log") == 0), "import_keep_aux").when(later, "import_aux").otherwise("import")
    )
    taken = F.when(action == "import_aux", F.col("a")).when(action.isin("import", "import_keep_aux"), F.col("version"))
    return rows.select("log_id", *key, action.alias("action"), taken.cast("long").alias("import_version"))


def pending_merge(items: DataFrame, stored: DataFrame) -> DataFrame:
    """items (write_seq, chunk_no, ..., without fp), stored (write_seq, chunk_no, fp, data_address): pending items get name and address of their chunk."""
    return items.join(stored.select("write_seq", "chunk_no", "fp", "data_address"), ["write_seq", "chunk_no"], "left")


def rebuild_modified(pair_items: DataFrame, log_id: int) -> DataFrame:
    """A pair's items (block_id, version, pos, fp, size, modifier) -> the mapping that was written: items of no size only tell what is gone."""
    return pair_items.where("size > 0").select("block_id", "version", F.lit(log_id).cast("long").alias("event_log_id"), "pos", "fp", "size")
