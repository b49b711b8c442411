"""Containers as stored things: exact packing, files with a checked payload, commits, deletion by rewriting, merging.

Packing is next-fit within a lane, and lanes take new chunks in turn. Where a container ends depends on where it
began, and so on all chunks before; but what follows a given beginning does not. So segments of a lane say, each
on its own, for every place at which a container may begin near their front, where the first one behind
their end begins and how many they hold. These tables are chained lane by lane, and then every segment packs its own items.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LANE_CHOICES
from ..schemas import CONTAINER_META, CONTAINER_SIZE, ITEM_META
from .ranking import ranked

LANES = 8
SEGMENT = 1 << 18  # items of a lane that one task packs
RANKED = 1 << 20


def round_robin(rank, lanes: int):
    """The lane of a new chunk by its 1-based number among the new chunks."""
    return F.pmod(rank - 1, F.lit(lanes))


LANE_CHOICES.add("round-robin", round_robin)


def room_of(capacity: int) -> int:
    """Bytes that items may take; small containers, as tests use, have no metadata area."""
    return capacity - CONTAINER_META if capacity > CONTAINER_META else capacity


def next_starts(sizes: np.ndarray, room: int) -> np.ndarray:
    """For a container that begins at each item: the item that no longer fits. An item fits if it and its metadata stay strictly below the room."""
    n = len(sizes)
    total = np.r_[0, np.cumsum(sizes)]
    by_bytes = np.searchsorted(total, total[:-1] + room - ITEM_META, "left") - 1  # first k with total[k + 1] - total[i] + ITEM_META >= room
    by_items = np.arange(n) + -(-CONTAINER_META // ITEM_META) - 1
    return np.minimum(np.maximum(np.minimum(by_bytes, by_items), np.arange(n) + 1), n)


def _own(group: pa.Table) -> tuple[int, int, np.ndarray, np.ndarray]:
    by = np.argsort(group.column("pos").to_numpy(), kind="stable")
    pos, size = group.column("pos").to_numpy()[by], group.column("size").to_numpy()[by]
    return group.column("lane")[0].as_py(), group.column("segment")[0].as_py(), pos, size


def _segment_table(group: pa.Table, room: int, segment: int, halo: int) -> pa.Table:
    """(lane, segment, exits, counts): for each place near the front at which a container may begin, where the first one behind the end begins and how many begin here."""
    lane, number, pos, size = _own(group)
    own = int((pos < (number + 1) * segment).sum())
    after = next_starts(size, room)
    exits, counts = np.zeros(own, np.int64), np.ones(own, np.int64)
    for i in range(own - 1, -1, -1):
        if after[i] < own:
            exits[i], counts[i] = exits[after[i]], counts[after[i]] + 1
        else:
            exits[i] = after[i] - own
    front = min(own, halo)
    return pa.table({"lane": [lane], "segment": [number], "exits": [exits[:front].tobytes()], "counts": [counts[:front].tobytes()]})


def _chained(group: pa.Table) -> pa.Table:
    """(lane, segment, entry, base): the first container that begins in each segment, and how many begin before."""
    rows = sorted(group.to_pylist(), key=lambda r: r["segment"])
    entry = base = 0
    out = []
    for r in rows:
        out.append((r["lane"], r["segment"], entry, base))
        exits, counts = np.frombuffer(r["exits"], np.int64), np.frombuffer(r["counts"], np.int64)
        if entry < len(exits):
            entry, base = int(exits[entry]), base + int(counts[entry])
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("lane", "segment", "entry", "base"), zip(*out, strict=True), strict=True)})


def _numbered(items: pa.Table, states: pa.Table, room: int) -> pa.Table:
    """Items with the number of their container in its lane, and whether they are its first."""
    by = np.argsort(items.column("pos").to_numpy(), kind="stable")
    items = items.take(pa.array(by))
    size = items.column("size").to_numpy()
    after = next_starts(size, room)
    first = np.zeros(len(size), bool)
    at = states.column("entry")[0].as_py()
    while at < len(size):
        first[at] = True
        at = int(after[at])
    number = states.column("base")[0].as_py() - 1 + np.cumsum(first)
    columns = [items.column(n) for n in ("fp", "size", "rank", "lane")]
    return pa.Table.from_arrays([*columns, pa.array(number, pa.int64()), pa.array(first)], names=["fp", "size", "rank", "lane", "number", "opens"])


def pack(index: DataFrame, capacity: int = CONTAINER_SIZE, lanes: int = LANES, lane_choice: str = "round-robin", segment: int = SEGMENT) -> DataFrame:
    """index (fp, size, first_seq, first_no) -> (fp, size, lane, container_id): next-fit within lanes, exactly.

    Lanes open their first containers at the start, with ids 1 to ``lanes``; later ids are given out in the order in which containers are opened.
    """
    room, halo = room_of(capacity), CONTAINER_META // ITEM_META + 2
    if segment < halo:
        raise ValueError(f"a segment holds at least {halo} items")
    new = ranked(index.select("fp", F.col("size").cast("long").alias("size"), "first_seq", "first_no"), ["first_seq", "first_no"], F.floor(F.col("first_seq") / 4096))
    placed = new.select("fp", "size", "rank", LANE_CHOICES.get(lane_choice)(F.col("rank"), lanes).cast("long").alias("lane"), F.floor((F.col("rank") - 1) / lanes).alias("pos"))
    placed = placed.withColumn("segment", F.floor(F.col("pos") / segment))
    # What a container of one segment may hold of the next goes there too, without its name.
    both = F.when((F.col("pos") % segment < halo) & (F.col("segment") > 0), F.array(F.col("segment"), F.col("segment") - 1)).otherwise(F.array("segment"))
    spread = placed.select("lane", "pos", "size", F.explode(both).alias("segment"))
    tables = spread.groupBy("lane", "segment").applyInArrow(lambda t: _segment_table(t, room, segment, halo), "lane long, segment long, exits binary, counts binary")
    states = tables.groupBy("lane").applyInArrow(_chained, "lane long, segment long, entry long, base long")
    numbered = (
        placed.groupBy("lane", "segment")
        .cogroup(states.groupBy("lane", "segment"))
        .applyInArrow(lambda i, s: _numbered(i, s, room), "fp string, size long, rank long, lane long, number long, opens boolean")
    )
    opened = numbered.where("opens").select("lane", "number", "rank")
    later = ranked(opened.where("number > 0"), ["rank"], F.floor(F.col("rank") / RANKED), "nth").select("lane", "number", (F.col("nth") + lanes).alias("container_id"))
    ids = opened.where("number = 0").select("lane", "number", (F.col("lane") + 1).alias("container_id")).unionByName(later)
    return numbered.join(ids, ["lane", "number"]).select("fp", "size", "lane", "container_id")


# Files

STORED = "container_id long, original_id long, fp string, raw_size long, deleted boolean, item_offset long, item_size long"
FILE = "container_id long, items array<struct<original_id: long, fp: string, raw_size: long, deleted: boolean, item_offset: long, item_size: long>>, payload binary, adler32 long"


def write_containers(items: DataFrame, path: str, partitions: int = 16) -> None:
    """items (container_id, original_id, fp, chunk, deleted) stored as containers: one row each, its items in order of fp, their bytes one behind the other, and a checksum of these.

    A container's capacity bounds a row. Files are dealt by container id, so that a lookup reads one folder.
    """

    def sealed(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["fp"], r["original_id"]))
        listed, at = [], 0
        for r in rows:
            listed.append({"original_id": r["original_id"], "fp": r["fp"], "raw_size": len(r["chunk"]), "deleted": r["deleted"], "item_offset": at, "item_size": len(r["chunk"])})
            at += len(r["chunk"])
        payload = b"".join(r["chunk"] for r in rows)
        schema = pa.schema([("container_id", pa.int64()), ("items", pa.list_(pa.struct([("original_id", pa.int64()), ("fp", pa.string()), ("raw_size", pa.int64()), ("deleted", pa.bool_()), ("item_offset", pa.int64()), ("item_size", pa.int64())]))), ("payload", pa.binary()), ("adler32", pa.int64())])
        return pa.Table.from_pylist([{"container_id": rows[0]["container_id"], "items": listed, "payload": payload, "adler32": zlib.adler32(payload)}], schema=schema)

    rows = items.select("container_id", "original_id", "fp", "chunk", "deleted").groupBy("container_id").applyInArrow(sealed, FILE)
    rows.withColumn("part", F.pmod("container_id", F.lit(partitions))).write.mode("append").partitionBy("part").parquet(path)


def container_items(spark, path: str) -> DataFrame:
    """The items of stored containers, without their bytes: the scan reads the columns of the metadata only."""
    stored = spark.read.parquet(path)
    return stored.select("container_id", F.inline("items")).select(*[c.split()[0] for c in STORED.split(", ")])


def load_items(spark, path: str, verify: bool = True) -> DataFrame:
    """Items with their bytes, and whether their container's payload is what was written; bytes of a damaged container are null."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [zlib.adler32(p.as_py()) == a.as_py() for p, a in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good), batch.column(3)], ["container_id", "payload", "ok", "items"])

    stored = spark.read.parquet(path).select("container_id", "payload", "adler32", "items")
    kind = FILE.split(", items ")[1].rpartition(", payload")[0]
    rows = stored.mapInArrow(checked, f"container_id long, payload binary, ok boolean, items {kind}") if verify else stored.withColumn("ok", F.lit(True))
    each = rows.select("container_id", "payload", "ok", F.inline("items"))
    piece = F.substring("payload", (F.col("item_offset") + 1).cast("int"), F.col("item_size").cast("int"))
    return each.select("container_id", "original_id", "fp", "raw_size", "deleted", F.when(F.col("ok"), piece).alias("chunk"), "ok")


def rewrite_deleted(items: DataFrame, gone: DataFrame, generation: int) -> tuple[DataFrame, DataFrame]:
    """items (container_id, original_id, fp, deleted, ...), gone (container_id, fp) -> the items of the containers that must be written anew, with
    their flags, and the move events (container_id, generation, active_items, active_bytes). Containers without a live item to delete stay where they are.
    """
    hit = gone.select("container_id", "fp", F.lit(True).alias("_gone")).distinct()
    marked = items.join(hit, ["container_id", "fp"], "left").withColumn("_new", F.coalesce("_gone", F.lit(False)) & ~F.col("deleted"))
    touched = marked.groupBy("container_id").agg(F.bool_or("_new").alias("_touched")).where("_touched").select("container_id")
    after = marked.join(touched, "container_id", "left_semi").withColumn("deleted", F.col("deleted") | F.col("_new")).drop("_gone", "_new")
    live = F.when(~F.col("deleted"), F.col("raw_size"))
    moved = after.groupBy("container_id").agg(F.count(live).alias("active_items"), F.coalesce(F.sum(live), F.lit(0)).cast("long").alias("active_bytes"))
    return after, moved.select("container_id", F.lit(generation).cast("long").alias("generation"), "active_items", "active_bytes")


def merged_items(items: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items (container_id, original_id, fp, raw_size, deleted), pairs (container_id, merge_group) -> the live items of merged containers and their
    addresses (container_id, primary_id). The smallest original id among a group's live items names the new container; other ids with live items
    redirect to it, ids without lose their address (null).
    """
    grouped = items.join(pairs, "container_id")
    live = grouped.where("not deleted")
    first = live.groupBy("merge_group").agg(F.min("original_id").alias("primary_id"))
    kept = live.join(first, "merge_group").select(F.col("primary_id").alias("container_id"), "original_id", "fp", "raw_size", "deleted")
    ids = grouped.select("merge_group", "original_id", "deleted").unionByName(grouped.select("merge_group", F.col("container_id").alias("original_id"), F.lit(True).alias("deleted")))
    alive = ids.groupBy("merge_group", "original_id").agg(F.bool_or(~F.col("deleted")).alias("alive"))
    addresses = alive.join(first, "merge_group", "left").select(F.col("original_id").alias("container_id"), F.when(F.col("alive"), F.col("primary_id")).alias("primary_id"))
    return kept, addresses


def find_items(requests: DataFrame, items: DataFrame, find_deleted: bool = False) -> DataFrame:
    """requests (fp, address) -> the container that holds the item under that id, its place there and whether it is deleted; deleted ones only if asked for."""
    held = items if find_deleted else items.where("not deleted")
    ids = held.select("fp", F.col("original_id").alias("address"), "container_id", "item_offset", "deleted")
    return requests.join(ids, ["fp", "address"], "left").select("fp", "address", "container_id", "item_offset", "deleted", F.col("container_id").isNotNull().alias("found"))


def commit_open(items: DataFrame, committed: DataFrame, capacity: int, last_log_id: int, force: bool = False) -> DataFrame:
    """Commit events of containers that are closed: the ones behind which their lane has opened another, and with ``force`` (a flush) the open ones too.

    items (lane, container_id, size), committed (container_id) -> (log_id, container_id, items, bytes, fill, event_type) in order of id.
    """
    sizes = items.groupBy("lane", "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("bytes"))
    newest = sizes.groupBy("lane").agg(F.max("container_id").alias("newest"))
    closed = sizes.join(newest, "lane").where(F.lit(force) | (F.col("container_id") < F.col("newest"))).join(committed.select("container_id"), "container_id", "left_anti")
    numbered = ranked(closed, ["container_id"], F.floor(F.col("container_id") / RANKED))
    return numbered.select((F.col("rank") + last_log_id).alias("log_id"), "container_id", "items", "bytes", F.round(F.col("bytes") / room_of(capacity), 6).alias("fill"), F.lit("container_committed").alias("event_type"))
