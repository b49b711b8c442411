import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwell.control import Control, shell
from chunkwell.functions.hashing import murmur3_x64_128, murmur3_x86_128
from chunkwell.operators import blocks, containers, events, mapping, ranking, storage, volumes
from chunkwell.schemas import BLOCK_SHIFT, CONTAINER_META, ITEM_META
from chunkwell.streaming.replay import EventLog


def test_wide_murmur3_known_values():
    text = b"The quick brown fox jumps over the lazy dog"
    assert murmur3_x64_128(text) == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)
    assert murmur3_x64_128(b"hello, world") == (0x342FAC623A5EBC8E, 0x4CDCBC079642414D)
    assert murmur3_x64_128(b"") == (0, 0) and murmur3_x86_128(b"") == (0, 0, 0, 0)
    assert murmur3_x86_128(text) == (0x2F1583C3, 0xECEE2C67, 0x5D7BF66C, 0xE5E91D2C)


def test_ranks_and_last_marks_need_no_window_over_all(spark):
    r = random.Random(3)
    keys = r.sample(range(5000), 400)
    df = spark.createDataFrame([(k, r.random() < 0.1) for k in keys], "k long, m boolean")
    got = {x["k"]: x["rank"] for x in ranking.ranked(df, ["k"], F.floor(F.col("k") / 64)).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}
    marks = {x["k"]: (x["m"], x["last"]) for x in ranking.last_marked(df, "k", F.col("m"), 64, "last").collect()}
    last = None
    for k in sorted(keys):
        last = k if marks[k][0] else last
        assert marks[k][1] == last


def packed_by_loop(sizes, capacity, lanes):
    """Container ids of chunks in order, one after the other."""
    room = containers.room_of(capacity)
    state, given, out = {k: (k + 1, 0, 0) for k in range(lanes)}, lanes, []
    for k, size in enumerate(sizes):
        number, used, items = state[k % lanes]
        if items and (used + size + ITEM_META >= room or (items + 1) * ITEM_META >= CONTAINER_META):
            given, used, items = given + 1, 0, 0
            number = given
        state[k % lanes] = (number, used + size, items + 1)
        out.append(number)
    return out


@pytest.mark.parametrize(("n", "capacity", "most", "segment"), [(4000, 3000, 400, 1600), (9000, 1 << 22, 40, 1520), (5000, 900, 2000, 2000), (30, 500, 100, 1 << 18)])
def test_packing_equals_the_loop_over_segment_borders(spark, n, capacity, most, segment):
    r = random.Random(n)
    sizes = [r.randrange(1, most) for _ in range(n)]
    index = spark.createDataFrame([(f"f{k}", k // 3 * 5000, k % 3, s) for k, s in enumerate(sizes)], "fp string, first_seq long, first_no long, size long").repartition(5)
    got = {x["fp"]: x["container_id"] for x in containers.pack(index, capacity, lanes=2, segment=segment).collect()}
    assert [got[f"f{k}"] for k in range(n)] == packed_by_loop(sizes, capacity, 2)


def test_packing_of_nothing(spark):
    assert containers.pack(spark.createDataFrame([], "fp string, first_seq long, first_no long, size long")).count() == 0
    with pytest.raises(ValueError):
        containers.pack(spark.createDataFrame([], "fp string, first_seq long, first_no long, size long"), segment=10)


def test_a_container_holds_its_metadata(spark):
    n = CONTAINER_META // ITEM_META + 5
    after = containers.next_starts(np.ones(n, np.int64), 1 << 22)
    assert after[0] == -(-CONTAINER_META // ITEM_META) - 1 and after[-1] == n


def greedy(rows, room):
    """The emptiest container with the fullest partner that fits, until none fits; no partner, no pair."""
    rows, out = sorted(rows), []
    while rows:
        a = rows.pop(0)
        k = next((k for k in range(len(rows) - 1, -1, -1) if rows[k][0] + a[0] < room), None)
        if k is None:
            continue
        b = rows.pop(k)
        out.append((min(a[1], b[1]), max(a[1], b[1]), a[0] + b[0]))
    return sorted(out)


def test_merge_pairs_equal_the_plain_greedy_ones(spark, monkeypatch):
    r = random.Random(7)
    rows = [(r.randrange(1, 900), k) for k in range(300)]
    df = spark.createDataFrame([(b, k, 3) for b, k in rows] + [(0, 1000, 0)], "active_bytes long, container_id long, active_items long")
    got = [tuple(x) for x in storage.merge_pairs(df, 1000).collect()]
    assert sorted(x for x in got if x[1] is not None) == greedy(rows, 1000) and [x for x in got if x[1] is None] == [(1000, None, 0)]
    monkeypatch.setattr(storage, "PAIR_SHARD", 20)  # in shards: other pairs, each sound, and few containers are left that could still have met
    got = [tuple(x) for x in storage.merge_pairs(df.where("active_bytes > 0"), 1000).collect()]
    used = [i for a, b, _ in got for i in (a, b)]
    size = {k: b for b, k in rows}
    assert len(set(used)) == len(used) and all(size[a] + size[b] == n < 1000 for a, b, n in got)
    left = sorted(size[k] for k in size if k not in set(used))
    assert len(left) < 2 or left[0] + left[1] >= 1000


def test_overlay_of_a_block_that_is_overwritten_again_and_again(spark):
    r = random.Random(2)
    rows = [(1, s, f"f{s}", r.randrange(200), r.randrange(1, 60)) for s in range(3000)] + [(2, 1, "x", 5, 5), (2, 1, "y", 8, 5), (3, 4, "z", 0, 0)]
    df = spark.createDataFrame([(b, s, f, a, 7, n) for b, s, f, a, n in rows], "block_id long, seq long, fp string, item_start long, chunk_offset long, item_size long")
    cells = {}
    for b, s, f, a, n in rows:
        for p in range(a, a + n):
            if cells.get((b, p), (-1, -1))[:2] <= (s, a):
                cells[b, p] = (s, a, f, 7 + p - a)
    got = {}
    for x in mapping.overlay(df).collect():
        for k in range(x["item_size"]):
            key = (x["block_id"], x["item_start"] + k)
            assert key not in got
            got[key] = (x["fp"], x["chunk_offset"] + k)
    assert got == {k: v[2:] for k, v in cells.items()}


def test_containers_are_written_read_and_checked(spark, tmp_path):
    rows = [(1, 1, "b", bytearray(b"bbb"), False), (1, 9, "a", bytearray(b""), True), (2, 2, "c", bytearray(b"\x00\xff"), False)]
    path = str(tmp_path / "c")
    containers.write_containers(spark.createDataFrame(rows, "container_id long, original_id long, fp string, chunk binary, deleted boolean"), path)
    items = containers.container_items(spark, path)
    assert "payload" not in items._jdf.queryExecution().executedPlan().toString()
    assert {(r["container_id"], r["fp"], r["item_offset"], r["item_size"]) for r in items.collect()} == {(1, "a", 0, 0), (1, "b", 0, 3), (2, "c", 0, 2)}
    back = {r["fp"]: (r["ok"], bytes(r["chunk"])) for r in containers.load_items(spark, path).collect()}
    assert back == {"a": (True, b""), "b": (True, b"bbb"), "c": (True, b"\x00\xff")}
    worse = str(tmp_path / "d")
    spark.read.parquet(path).withColumn("adler32", F.col("adler32") + (F.col("container_id") == 1).cast("long")).write.partitionBy("part").parquet(worse)
    assert {r["fp"]: (r["ok"], r["chunk"] is None) for r in containers.load_items(spark, worse).collect()} == {"a": (False, True), "b": (False, True), "c": (True, False)}
    asked = spark.createDataFrame([("a", 9), ("b", 1), ("b", 2)], "fp string, address long")
    assert {(r["fp"], r["address"]): r["found"] for r in containers.find_items(asked, items).collect()} == {("a", 9): False, ("b", 1): True, ("b", 2): False}
    assert {r["found"] for r in containers.find_items(asked.limit(1), items, find_deleted=True).collect()} == {True}


def test_merging_moves_live_items_only(spark):
    items = spark.createDataFrame([(5, 5, "a", 1, True), (6, 6, "b", 1, False), (7, 3, "c", 1, False), (7, 7, "d", 1, True)], "container_id long, original_id long, fp string, raw_size long, deleted boolean")
    kept, addresses = containers.merged_items(items, spark.createDataFrame([(5, 1), (6, 1), (7, 1)], "container_id long, merge_group long"))
    assert {(r["container_id"], r["original_id"], r["fp"]) for r in kept.collect()} == {(3, 6, "b"), (3, 3, "c")}
    assert {r["container_id"]: r["primary_id"] for r in addresses.collect()} == {3: 3, 5: None, 6: 3, 7: None}


def test_blocks_are_refused_deleted_and_read_through_tiers(spark):
    item = "block_id long, fp string, item_start long, chunk_offset long, item_size long"
    tier = lambda *r: spark.createDataFrame([(b, f, 0, 0, n) for b, f, n in r], item)
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "block_id long")
    got = blocks.read_blocks(asked, tier((1, "s", 4)), tier((1, "a", 9), (2, "a", 9)), tier((1, "m", 10), (2, "m", 10), (3, "m", 10)), 10)
    assert {(r["block_id"], r["fp"], r["item_size"]) for r in got.collect()} == {(1, "s", 4), (1, "02", 6), (2, "a", 9), (2, "02", 1), (3, "m", 10), (4, "02", 10)}
    out = blocks.delete_blocks(asked, tier((1, "m", 1), (2, "m", 1), (2, "m", 1), (3, "02", 1)), tier((1, "a", 1)), asked.where("block_id = 2")).collect()
    assert {(r["block_id"], r["outcome"], r["fp"], r["delta"]) for r in out} == {(1, "deleted", "a", -1), (2, "volatile", None, None), (3, "deleted", None, None), (4, "not_found", None, None)}


def test_written_events_by_mode(spark):
    e = spark.createDataFrame([(10, 1, 2), (11, 2, 1), (12, 3, 1), (13, 4, 1), (14, 5, 1), (15, 6, 1)], "log_id long, block_id long, version long")
    main = spark.createDataFrame([(1, 1), (2, 1)], "block_id long, version long")
    aux = spark.createDataFrame([(1, 2, 9), (2, 1, 9), (3, 1, 9), (4, 3, 0), (5, 3, 20)], "block_id long, version long, event_log_id long")
    none = e.limit(0)
    said = lambda mode, failed=none, opened=none: {r["block_id"]: (r["action"], r["import_version"]) for r in blocks.replay_written(e, main, aux, failed, opened, mode).collect()}
    assert {a for a, _ in said(blocks.DIRECT).values()} == {"ignore"}
    assert said(blocks.BACKGROUND) == {1: ("import", 2), 2: ("skip_old", None), 3: ("import", 1), 4: ("import_keep_aux", 1), 5: ("import_aux", 3), 6: ("skip_deleted", None)}
    assert said(blocks.BACKGROUND, e.where("block_id = 1"), e.where("block_id = 3"))[1] == ("skip_failed", None)
    assert said(blocks.BACKGROUND, none, e.where("block_id = 3"))[3] == ("mark_failed", None)
    assert said(blocks.DIRTY) == {1: ("volatile", None), 2: ("skip_old", None), 3: ("volatile", None), 4: ("volatile", None), 5: ("error", None), 6: ("volatile", None)}
    with pytest.raises(ValueError):
        said("sideways")


LOG = "log_id long, event_type string, seq long"


def test_a_log_is_only_appended_to_and_survives_a_stop(spark, tmp_path):
    new = lambda *r: spark.createDataFrame(list(r), "seq long, event_type string")
    log = EventLog(spark, str(tmp_path), LOG)
    assert log.last_id() == 0 and log.position("a") == 1 and not log.note_empty("a")
    log.commit(new((1, "container_open"), (2, "log_empty"), (3, "container_committed"), (4, "container_committed")), "seq")
    assert [(r["log_id"], r["seq"]) for r in log.read().orderBy("log_id").collect()] == [(1, 1), (2, 3), (3, 4)]  # only persistent types are numbered
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").glob("*.parquet")}
    seen = []

    def consumer(rows):
        seen.append(sorted((r["log_id"], r["batch"]) for r in rows.collect()))
        return rows.select("log_id", "batch")

    def stopped(rows):
        consumer(rows).count()
        raise RuntimeError("killed")

    assert log.background({"a": stopped, "b": consumer}, 1) == {"a": "failed", "b": "done"}
    log.commit(new((5, "volume_attach")), "seq")
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    again = EventLog(spark, str(tmp_path), LOG)  # as after a restart
    assert again.position("a") == 1 and again.position("b") == 4
    dirty = {r["log_id"] for r in again.dirty("b", lambda rows: rows.select("log_id")).collect()}
    assert dirty == {4} and again.position("b") == 4
    assert again.background({"a": consumer, "b": consumer}, 1) == {"a": "done", "b": "done"}
    assert [r[0] for r in again.results("a").orderBy("log_id").select("log_id").collect()] == [1, 2, 3, 4] == [r[0] for r in again.results("b").orderBy("log_id").select("log_id").collect()]
    assert again.background({"a": consumer}) == {"a": "empty"}
    assert again.note_empty("a") and not again.note_empty("a") and again.last_id() == 5
    assert seen[0] == [(1, 1), (2, 2), (3, 3)]


def test_runs_are_cut_at_types_and_at_the_number(spark):
    kinds = "aaabbaaaaac"
    log = spark.createDataFrame([(k + 1, c) for k, c in enumerate(kinds)], "log_id long, event_type string")
    got = [r["batch"] for r in events.runs(log, 2).orderBy("log_id").collect()]
    assert got == [1, 1, 3, 4, 4, 6, 6, 8, 8, 10, 11]
    assert [r["batch"] for r in events.runs(log, 9, 3).orderBy("log_id").collect()] == [3, 4, 4, 6, 6, 6, 6, 6, 11]


def test_ranges_of_volumes(spark):
    v = spark.createDataFrame([(1, 100, False), (2, 100, True)], "volume_id int, logical_size long, maintenance boolean")
    r = spark.createDataFrame([(1, 1, 0, 100), (2, 1, 1, 100), (3, 1, -1, 5), (4, 2, 0, 1), (5, 9, 0, 1)], "write_seq long, volume_id int, offset long, size long")
    state = lambda volumes_: {x["write_seq"]: x["state"] for x in volumes.check_requests(r, volumes_).collect()}
    assert state(v) == {1: "ok", 2: "out_of_range", 3: "out_of_range", 4: "not_ready", 5: "no_volume"}
    assert state(volumes.resize(v, spark.createDataFrame([(1, 101)], "volume_id int, logical_size long")))[2] == "ok"


def test_a_copy_goes_on_from_where_it_stopped(spark):
    at = lambda v, b: (v << BLOCK_SHIFT) | b
    items = spark.createDataFrame([(at(1, b), f"f{b}", 0, 0, 10) for b in range(6)] + [(at(2, 0), "other", 0, 0, 10)], "block_id long, fp string, item_start long, chunk_offset long, item_size long")
    job = spark.createDataFrame([(1, 3, 45, 13)], "src int, dst int, size long, done long")
    steps, copied = volumes.copy_volume(job, items, 10, 20)
    assert [(r["offset"], r["size"]) for r in steps.orderBy("step").collect()] == [(13, 20), (33, 12)]
    got = {(r["block_id"] - at(3, 0), r["fp"], r["item_start"], r["chunk_offset"], r["item_size"]) for r in copied.collect()}
    assert got == {(1, "f1", 3, 3, 7), (2, "f2", 0, 0, 10), (3, "f3", 0, 0, 10), (4, "f4", 0, 0, 5)}
    with pytest.raises(ValueError):
        volumes.copy_volume(job, items, 10, 15)


def test_the_shell_answers_and_goes_on(spark):
    log = spark.createDataFrame([(1, "x", 7, -1, 3)], "log_id long, event_type string, fp long, delta long, block_id long")
    out = io.StringIO()
    control = Control({"log": log, "index": spark.createDataFrame([("a", 5, 1)], "fp string, size long, usage_count long")})
    shell(control, ["log 1\n", "nothing\n", "\n", "idle sideways\n", "log\n", "gc pause\n", "chunk a\n", "quit\n", "log 1\n"], out)
    lines = out.getvalue().splitlines()
    assert lines[:2] == ["event_type x", "fp 7"] and [x.split(":")[0] for x in lines[2:5]] == ["error"] * 3
    assert lines[5:] == ["candidates 1", "size 5", "usage_count 1"] and control.paused
