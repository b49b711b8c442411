"""Containers: packing, deletion, merging; garbage collection; checks and repair."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import COLLECTORS, CONTAINER_COLLECTORS
from ..functions.fingerprints import fingerprint
from ..schemas import CONTAINER_META, ITEM_META
from ..sources.shared import kept
from .containers import room_of


def delete_items(items: DataFrame, gone: DataFrame) -> DataFrame:
    """Containers after deletions: live items and bytes."""
    live = items.join(gone.select("fp", F.lit(True).alias("deleted")), "fp", "left").withColumn("live", F.col("deleted").isNull())
    count = lambda c: F.coalesce(F.sum(F.when(F.col("live"), c)), F.lit(0))
    return live.groupBy("container_id").agg(count(F.lit(1).cast("long")).alias("active_items"), count(F.col("size")).alias("active_bytes"), F.count(F.lit(1)).alias("all_items"))


def merge_candidates(fill_state: DataFrame, capacity: int, share: float = 0.4, bucket: int = 4096, touched: DataFrame | None = None) -> DataFrame:
    """Containers with few live bytes and items, by size bucket; ones that were changed a moment ago (``touched``, container_id) wait. Two of them never have too many items for one."""
    most = share * (CONTAINER_META // ITEM_META)
    few = fill_state.where((F.col("active_bytes") <= share * room_of(capacity)) & (F.col("active_items") <= most)).withColumn("bucket", F.floor(F.col("active_bytes") / bucket))
    if touched is not None:
        few = few.join(touched.select("container_id"), "container_id", "left_anti")
    return few.select("container_id", "active_bytes", "active_items", "bucket")


PAIR_SHARD = 200_000  # candidates that one task pairs; two numbers each


def merge_pairs(candidates: DataFrame, capacity: int) -> DataFrame:
    """Greedy pairs: the emptiest container with the fullest partner that still fits (strictly); an empty container is deleted without one (secondary_id null).

    Candidates of all buckets are paired in one task as long as there are no more than PAIR_SHARD of them. Beyond that they are dealt into shards, and what
    the shards leave over is paired with itself in one more pass; a shard leaves at most one container that could still have fitted another.
    """
    most, room = CONTAINER_META // ITEM_META, room_of(capacity)

    def paired(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(n).to_pylist() for n in ("active_bytes", "container_id", "active_items")), strict=True))
        out, left = [], []
        empty = [r for r in rows if not r[0] and not r[2]]
        out += [(r[1], None, 0, 0) for r in empty]
        rows = [r for r in rows if r[0] or r[2]]
        lo, hi = 0, len(rows) - 1
        while lo < hi:
            a, b = rows[lo], rows[hi]
            if a[0] + b[0] < room and a[2] + b[2] < most:
                out.append((min(a[1], b[1]), max(a[1], b[1]), a[0] + b[0], a[2] + b[2]))
                lo += 1
            else:
                left.append(b)
            hi -= 1
        left += rows[lo : hi + 1]
        out += [(None, r[1], r[0], r[2]) for r in left]  # not paired
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("primary_id", "secondary_id", "bytes", "items"), columns, strict=True)})

    schema = "primary_id long, secondary_id long, bytes long, items long"
    rows = kept(candidates.select(*[F.col(c).cast("long").alias(c) for c in ("active_bytes", "container_id", "active_items")]), "candidates")
    shards = -(-rows.count() // PAIR_SHARD) or 1
    first = rows.groupBy(F.expr(f"pmod(xxhash64(container_id), {shards})").alias("shard")).applyInArrow(paired, schema)
    if shards > 1:
        first = kept(first, "pairs")
        over = first.where("primary_id is null").select(F.col("bytes").alias("active_bytes"), F.col("secondary_id").alias("container_id"), F.col("items").alias("active_items"))
        again = over.groupBy(F.lit(0).alias("shard")).applyInArrow(paired, schema)  # containers that find no partner among PAIR_SHARD others: few
        first = first.where("primary_id is not null").unionByName(again)
    return first.where("primary_id is not null").select("primary_id", "secondary_id", "bytes")


# Garbage collection


def usage_counts(log: DataFrame) -> DataFrame:
    """Per fingerprint: the sum of its changes, each (log_id, fp) once, and the last one's id and block."""
    once = log.dropDuplicates(["log_id", "fp"])
    return once.groupBy("fp").agg(F.sum("delta").alias("usage_count"), F.max("log_id").alias("change_log_id"), F.max_by("block_id", "log_id").alias("block_hint"))


def collect(counts: DataFrame, in_combat: DataFrame) -> DataFrame:
    """What becomes of each candidate (usage at most 0): kept if an unreplayed event touches it, deleted at 0, else kept for a check."""
    busy = in_combat.select("fp").distinct().withColumn("busy", F.lit(True))
    action = F.when(F.col("busy"), "keep").when(F.col("usage_count") == 0, "delete").otherwise("recheck")
    return counts.where("usage_count <= 0").join(busy, "fp", "left").select("fp", "usage_count", action.alias("action"))


def revert_failed(counts: DataFrame, failed: DataFrame) -> DataFrame:
    """Counts after failed writes, each reverted once: failed (write_event_log_id, fp, delta)."""
    undone = failed.dropDuplicates(["write_event_log_id", "fp"]).groupBy("fp").agg((-F.sum("delta")).alias("undo"))
    return counts.join(undone, "fp", "left").select("fp", (F.col("usage_count") + F.coalesce("undo", F.lit(0))).alias("usage_count"))


def direct_replay(index: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """index (fp, usage_count, change_log_id, block_hint), events (log_id, block_id, fp, delta) -> the index after the events were applied directly, and those
    refused (log_id, fp): an event whose id is not above the row's change id has been applied before. Fingerprints that the index lacks are passed over.
    """
    once = events.where("delta <> 0").dropDuplicates(["log_id", "fp"])
    judged = once.join(index.select("fp", F.col("change_log_id").alias("_seen")), "fp").withColumn("_old", F.col("log_id") <= F.coalesce("_seen", F.lit(0)))
    fresh = judged.where(~F.col("_old")).groupBy("fp").agg(F.sum("delta").alias("_delta"), F.max("log_id").alias("_log"), F.max_by("block_id", "log_id").alias("_hint"))
    after = index.join(fresh, "fp", "left").select(
        "fp", (F.col("usage_count") + F.coalesce("_delta", F.lit(0))).alias("usage_count"), F.coalesce("_log", "change_log_id").alias("change_log_id"), F.coalesce("_hint", "block_hint").alias("block_hint")
    )
    return after, judged.where("_old").select("log_id", "fp")


def background_candidates(index: DataFrame, events: DataFrame) -> DataFrame:
    """(log_id, fp) of candidates that a background replay of events (log_id, fp) finds: unused, and no later event changed the row, which then would find it itself.

    index (fp, usage_count, change_log_id, failed_log_id).
    """
    later = F.greatest(F.coalesce("change_log_id", F.lit(0)), F.coalesce("failed_log_id", F.lit(0)))
    return events.join(index, "fp").where((F.col("usage_count") <= 0) & (later <= F.col("log_id"))).select("log_id", "fp").distinct()


def is_candidate(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """asked (container_id, fp) -> whether each is a candidate of its container."""
    hit = candidates.select("container_id", "fp", F.lit(True).alias("_hit")).distinct()
    return asked.join(hit, ["container_id", "fp"], "left").select("container_id", "fp", F.coalesce("_hit", F.lit(False)).alias("candidate"))


def in_combat(log: DataFrame, position: int) -> DataFrame:
    """Fingerprints that events behind the replay position touch."""
    return log.where(F.col("log_id") > position).select("fp").distinct()


def orphans(listed: DataFrame, counts: DataFrame) -> DataFrame:
    """Listed fingerprints that are indexed and unused are candidates of failed writes; unknown ones are ignored."""
    return counts.where("usage_count <= 0").join(listed.select("fp"), "fp", "left_semi").select("fp", "usage_count", F.lit("failed").alias("type"))


def failed_candidates(failed: DataFrame, counts: DataFrame) -> DataFrame:
    """What failed writes (fp, delta) had added and the index now lacks, or holds unused."""
    added = failed.where("delta > 0").select("fp").distinct()
    return added.join(counts.select("fp", "usage_count"), "fp", "left").where("usage_count is null or usage_count <= 0").select("fp", F.lit("failed").alias("type"))


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """Candidates (container_id, fp, type) by container and type, each fingerprint once; a container's room bounds its list."""
    return candidates.groupBy("container_id", "type").agg(F.sort_array(F.collect_set("fp")).alias("fps"))


def process_candidates(candidates: DataFrame, counts: DataFrame, busy: DataFrame) -> DataFrame:
    """Candidates (fp, type) with what becomes of them.

    One that an unreplayed event touches is kept, as is one of a failed write that the index does not know. One that is in use, or that
    nothing knows, is dropped as a candidate; an unused one is deleted with its index row.
    """
    known = candidates.join(counts.select("fp", "usage_count"), "fp", "left").join(busy.select("fp").distinct().withColumn("busy", F.lit(True)), "fp", "left")
    unknown = F.col("usage_count").isNull()
    action = F.when(F.col("busy") | (unknown & (F.col("type") == "failed")), "keep").when(unknown | (F.col("usage_count") != 0), "drop").otherwise("delete")
    return known.select("fp", "type", "usage_count", action.alias("action"))


def anchor_hints(log: DataFrame, anchor: Column) -> DataFrame:
    """Without counting, a log only gives anchors the last event's id and block."""
    return log.where(anchor).groupBy("fp").agg(F.max("log_id").alias("change_log_id"), F.max_by("block_id", "log_id").alias("block_hint"))


# Versions of blocks


def volatile_states(mappings: DataFrame, containers: DataFrame) -> DataFrame:
    """mappings (block_id, version, container_id), containers (container_id, state) -> (block_id, version, state).

    A failed container fails every version that uses it and all later ones of the block; a version is committed once its containers and
    all earlier versions are. First failed and first open versions come from aggregates, so a block of many versions loads no task.
    """
    state = F.coalesce("state", F.lit("open"))
    used = mappings.join(containers.select("container_id", "state"), "container_id", "left").groupBy("block_id", "version").agg(
        F.bool_or(state == "failed").alias("failed"), F.bool_and(state == "committed").alias("done")
    )
    first = used.groupBy("block_id").agg(F.min(F.when(F.col("failed"), F.col("version"))).alias("broken"), F.min(F.when(~F.col("done"), F.col("version"))).alias("pending"))
    verdict = F.when(F.col("version") >= F.col("broken"), "failed").when(F.col("version") >= F.col("pending"), "volatile").otherwise("committed")
    return used.join(first, "block_id").select("block_id", "version", verdict.alias("state"))


def import_ready(main: DataFrame, aux: DataFrame, ready: DataFrame, key: str) -> DataFrame:
    """main and aux (key, version, ...), ready (key, version): an auxiliary row moves to main if it is the ready version and main's is lower."""
    fresh = aux.join(ready.select(key, "version"), [key, "version"], "left_semi")
    older = main.select(key, F.col("version").alias("_main"))
    fresh = fresh.join(older, key, "left").where(F.col("_main").isNull() | (F.col("_main") < F.col("version"))).select(*main.columns)
    return main.join(fresh.select(key), key, "left_anti").unionByName(fresh)


# Checks


def violations(items: DataFrame, index: DataFrame, stored: DataFrame, listed: DataFrame, fingerprint_kind: str = "sha1") -> DataFrame:
    """(kind, key, detail) of everything that does not fit together.

    items (fp, address), index (fp, address, usage_count), stored (fp, address, chunk, deleted), listed (fp): candidates of the collection. Stored bytes are
    hashed again; the index is looked up from the block items, from the stored items and the other way round; an unused index row must be a candidate.
    """
    used = items.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("address").alias("address"))
    live = stored.where("not deleted").select("fp", "address", (fingerprint(F.col("chunk"), fingerprint_kind)).alias("real_fp"))
    u, x = used.alias("u"), index.alias("x")
    both = u.join(x, F.col("u.fp") == F.col("x.fp"), "full").join(listed.select("fp", F.lit(True).alias("listed")).distinct().alias("c"), F.col("x.fp") == F.col("c.fp"), "left")
    row = lambda kind, key, detail: F.struct(F.lit(kind).alias("kind"), key.alias("key"), detail.cast("string").alias("detail"))
    counted = F.coalesce("u.n", F.lit(0).cast("long"))
    by_block = both.select(
        F.array_compact(
            F.array(
                F.when(F.col("x.fp").isNull(), row("missing_index", F.col("u.fp"), F.col("u.n"))),
                F.when(F.col("u.address") != F.col("x.address"), row("wrong_address", F.col("u.fp"), F.col("x.address"))),
                F.when(F.col("x.fp").isNotNull() & (counted != F.col("x.usage_count")), row("usage_count", F.col("x.fp"), counted - F.col("x.usage_count"))),
                F.when((F.col("x.usage_count") <= 0) & F.col("c.listed").isNull(), row("no_candidate", F.col("x.fp"), F.col("x.usage_count"))),
            )
        ).alias("v")
    ).select(F.inline("v"))
    s, i = live.alias("s"), index.select("fp", "address").alias("i")
    held = s.join(i, F.col("s.fp") == F.col("i.fp"), "left")
    by_container = held.select(
        F.array_compact(
            F.array(
                F.when(F.col("i.fp").isNull(), row("item_not_indexed", F.col("s.fp"), F.col("s.address"))),
                F.when(F.col("i.address") != F.col("s.address"), row("item_address", F.col("s.fp"), F.col("i.address"))),
                F.when(~F.col("s.real_fp").eqNullSafe(F.col("s.fp")), row("rehash", F.col("s.fp"), F.coalesce("s.real_fp", F.lit("lost")))),
            )
        ).alias("v")
    ).select(F.inline("v"))
    lost = index.join(live.select("fp", "address"), ["fp", "address"], "left_anti").select(F.lit("missing_item").alias("kind"), F.col("fp").alias("key"), F.col("address").cast("string").alias("detail"))
    return by_block.unionByName(by_container).unionByName(lost)


def redirect_violations(addresses: DataFrame, items: DataFrame) -> DataFrame:
    """addresses (container_id, primary_id, file_id, file_offset), items (container_id, original_id) -> faults of the address table: a redirect that leads to another
    redirect or nowhere, two containers at one place, an id that redirects to a container without any item of it.
    """
    a, b = addresses.alias("a"), addresses.alias("b")
    moved = a.where("primary_id is not null").join(b, F.col("a.primary_id") == F.col("b.container_id"), "left")
    kind = F.when(F.col("b.container_id").isNull(), "redirect_lost").when(F.col("b.primary_id").isNotNull(), "redirect_chain")
    chained = moved.select(kind.alias("kind"), F.col("a.container_id").alias("key"), F.col("a.primary_id").alias("detail")).where("kind is not null")
    placed = addresses.where("primary_id is null").groupBy("file_id", "file_offset").agg(F.count(F.lit(1)).alias("n"), F.min("container_id").alias("key")).where("n > 1")
    same = placed.select(F.lit("same_place").alias("kind"), "key", F.col("n").alias("detail"))
    told = addresses.where("primary_id is not null").select(F.col("primary_id").alias("container_id"), F.col("container_id").alias("original_id"))
    bare = told.join(items.select("container_id", "original_id"), ["container_id", "original_id"], "left_anti")
    return chained.unionByName(same).unionByName(bare.select(F.lit("redirect_unused").alias("kind"), F.col("original_id").alias("key"), F.col("container_id").alias("detail")))


def restore_index(container_items: DataFrame, block_items: DataFrame) -> DataFrame:
    """The index from what containers hold (live items), with counts from block items."""
    used = block_items.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    return container_items.where("not deleted").join(used, "fp", "left").select("fp", F.col("container_id").alias("address"), F.coalesce("n", F.lit(0)).alias("usage_count"))


def adler32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow on (key, bytes): key and the bytes' Adler-32."""
    import zlib

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.adler32(x.as_py()) for x in batch.column(1)], pa.int64())], ["key", "adler32"])


def _pack_bytes(codec: str, raw: bytes) -> bytes:
    import bz2
    import zlib

    if codec == "deflate":
        return zlib.compress(raw, 1)
    return bz2.compress(raw) if codec == "bz2" else pa.compress(raw, codec=PYARROW_CODECS[codec], asbytes=True)


def _unpack_bytes(codec: str, stored: bytes, size: int) -> bytes:
    import bz2
    import zlib

    if codec == "deflate":
        return zlib.decompress(stored)
    return bz2.decompress(stored) if codec == "bz2" else pa.decompress(stored, size, codec=PYARROW_CODECS[codec], asbytes=True)


PYARROW_CODECS = {"snappy": "snappy", "lz4": "lz4_raw"}
CODECS = ("deflate", "bz2", *PYARROW_CODECS)
LEAST_COMPRESSED = 128  # smaller items stay as they are
SEALED = "fp string, asked string, codec string, raw_size long, stored binary, adler32 long"
UNSEALED = "fp string, asked string, chunk binary, ok boolean"


def seal(*codecs: str):
    """For mapInArrow on (fp, chunk): items as containers hold them, once for each codec (``asked``), compressed where that is smaller (``codec`` is null
    elsewhere), with a checksum of the stored bytes.
    """
    import zlib

    if odd := [c for c in codecs if c not in CODECS]:
        raise ValueError(f"no codec {odd[0]}; there are {CODECS}")

    def sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py() for x in batch.column(1)]
            for codec in codecs:
                small = [_pack_bytes(codec, x) if len(x) >= LEAST_COMPRESSED else x for x in raw]
                used = [len(y) < len(x) for x, y in zip(raw, small, strict=True)]
                stored = [y if u else x for x, y, u in zip(raw, small, used, strict=True)]
                columns = [
                    batch.column(0), pa.array([codec] * len(raw), pa.string()), pa.array([codec if u else None for u in used], pa.string()), pa.array([len(x) for x in raw], pa.int64()),
                    pa.array(stored, pa.binary()), pa.array([zlib.adler32(x) for x in stored], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["fp", "asked", "codec", "raw_size", "stored", "adler32"])

    return sealed


def unseal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow on sealed items: (fp, asked, chunk, ok); a checksum that does not match gives no bytes."""
    import zlib

    for batch in batches:
        out = []
        for codec, size, stored, check in zip(*(batch.column(n).to_pylist() for n in ("codec", "raw_size", "stored", "adler32")), strict=True):
            ok = zlib.adler32(stored) == check
            out.append((_unpack_bytes(codec, stored, size) if codec else stored) if ok else None)
        names = [batch.column(batch.schema.get_field_index(n)) for n in ("fp", "asked")]
        yield pa.RecordBatch.from_arrays([*names, pa.array(out, pa.binary()), pa.array([x is not None for x in out])], ["fp", "asked", "chunk", "ok"])


def commit_state(addresses: DataFrame, committed: DataFrame, known_at_start: int) -> DataFrame:
    """Of each address: committed, never (an id given out before the start that was not committed), or open."""
    done = committed.select(F.col("container_id").alias("address"), F.lit(True).alias("done"))
    state = F.when(F.col("done"), "committed").when(F.col("address") <= known_at_start, "never").otherwise("open")
    return addresses.join(done, "address", "left").select("address", state.alias("state"))


def import_containers(index: DataFrame, items: DataFrame) -> DataFrame:
    """The index (fp, address) after committed containers' live, indexed items that are still at their first container were put into it."""
    fresh = items.where("not deleted and indexed and original_id = container_id").groupBy("fp").agg(F.min("container_id").alias("address"))
    return index.join(fresh.select("fp"), "fp", "left_anti").select("fp", "address").unionByName(fresh)


def drop_failed(cache: DataFrame, failed: DataFrame) -> DataFrame:
    """Cached entries (fp, address) without those of failed containers; an entry that points elsewhere stays."""
    return cache.join(failed.select("fp", "address"), ["fp", "address"], "left_anti")


def resolve(addresses: DataFrame, redirects: DataFrame) -> DataFrame:
    """Addresses with redirects (container_id, primary_id) followed, one level deep."""
    to = redirects.select(F.col("container_id").alias("address"), "primary_id")
    return addresses.join(to, "address", "left").withColumn("address", F.coalesce("primary_id", "address")).drop("primary_id")


def load_containers(index: DataFrame, items: DataFrame) -> DataFrame:
    """After a crash: live, indexed items at their first container that the index (fp, address, usage_count) lacks enter it unused."""
    fresh = items.where("not deleted and indexed and original_id = container_id").groupBy("fp").agg(F.min("container_id").alias("address")).join(index.select("fp"), "fp", "left_anti")
    return index.select("fp", "address", "usage_count").unionByName(fresh.withColumn("usage_count", F.lit(0).cast("long")))


def merge_containers(items: DataFrame, groups: DataFrame) -> DataFrame:
    """items (container_id, original_id, deleted), groups (container_id, merge_group) -> what becomes of each original id.

    The smallest id that still has live items is the primary one; others with live items redirect to it, the rest are removed.
    """
    ids = items.join(groups, "container_id").groupBy("merge_group", "original_id").agg(F.sum((~F.col("deleted")).cast("long")).alias("live_items"))
    first = ids.where("live_items > 0").groupBy("merge_group").agg(F.min("original_id").alias("primary_id"))
    role = F.when(F.col("original_id") == F.col("primary_id"), "primary").when(F.col("live_items") > 0, "secondary").otherwise("removed")
    return ids.join(first, "merge_group", "left").select("merge_group", "original_id", "live_items", F.when(F.col("live_items") > 0, F.col("primary_id")).alias("primary_id"), role.alias("role"))


def idle_containers(writes: DataFrame, seconds: int) -> DataFrame:
    """Open containers (container_id, ts) by their last write; those idle for longer than ``seconds`` before the latest of all are to be committed."""
    last = writes.groupBy("container_id").agg(F.max("ts").alias("last_ts"))
    now = last.agg(F.max("last_ts").alias("now"))  # one row
    idle = F.unix_micros("now") - F.unix_micros("last_ts") > seconds * 1_000_000
    return last.join(F.broadcast(now)).select("container_id", idle.alias("commit"))


def read_items(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """requests (fp, address, lo, n), stored (fp, address, chunk, deleted) -> their bytes in hex: short at the end, null if deleted or absent."""
    piece = F.substring("chunk", (F.col("lo") + 1).cast("int"), F.col("n").cast("int"))
    return requests.join(stored.where("not deleted"), ["fp", "address"], "left").select("fp", F.lower(F.hex(piece)).alias("data"))


def repair_index(index: DataFrame, items: DataFrame, stored: DataFrame) -> DataFrame:
    """The index with addresses from containers and counts from block items, and whether a row had to change. stored: one row a fingerprint."""
    used = items.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    place = stored.select("fp", F.col("address").alias("place"))
    both = place.join(used, "fp", "left").join(index, "fp", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    same = F.col("address").eqNullSafe(F.col("place")) & F.col("usage_count").eqNullSafe(F.col("n"))
    return both.select("fp", F.col("place").alias("address"), F.col("n").alias("usage_count"), (~same).alias("repaired"))


COLLECTORS.add("usage-count", usage_counts)
COLLECTORS.add("none", anchor_hints)
CONTAINER_COLLECTORS.add("greedy", lambda state, capacity: merge_pairs(merge_candidates(state, capacity), capacity))
