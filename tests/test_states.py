import codecs
import random
import zlib

import pytest
from pyspark.sql import functions as F

from chunkwell.functions.hashing import murmur3, murmur3_batches, rot13
from chunkwell.operators import chunking, dedup, locality, mapping, storage
from chunkwell.schemas import CONTAINER_META, EMPTY_FP, ITEM_META

ITEMS = "block_id long, fp string, item_start long, chunk_offset long, item_size long"


def test_murmur3_known_values(spark):
    assert list(murmur3([b"", b"hello", b"hello, world"])) == [0, 0x248BFA47, 0x149BBB7F]
    assert list(murmur3([b"The quick brown fox jumps over the lazy dog"], 0x9747B28C)) == [0x2FA826CD]
    assert len(murmur3([])) == 0
    rnd = random.Random(1)
    values = [rnd.randbytes(rnd.randrange(40)) for _ in range(200)]
    assert list(murmur3(values)) == [int(murmur3([v])[0]) for v in values]
    got = spark.createDataFrame([(1, bytearray(b"hello")), (2, None)], "k long, b binary").mapInArrow(murmur3_batches, "k long, h long").collect()
    assert {r["k"]: r["h"] for r in got} == {1: 0x248BFA47, 2: 0}


def test_rot13_and_crc32(spark):
    got = spark.createDataFrame([("Customer#1 zZ",)], "t string").select(rot13(F.col("t")).alias("a"), F.crc32("t").alias("b")).first()
    assert got["a"] == codecs.encode("Customer#1 zZ", "rot13") and got["b"] == zlib.crc32(b"Customer#1 zZ")


def test_missing_blocks_are_zeros_in_pieces(spark):
    items = spark.createDataFrame([(1, "a", 100, 0, 50)], ITEMS)
    blocks = spark.createDataFrame([(1,), (2,), (2,)], "block_id long")
    got = [tuple(r) for r in mapping.fill_empty(blocks, items, 256 * 1024).orderBy("block_id", "item_start").collect()]
    assert got[:2] == [(1, EMPTY_FP, 0, 0, 100), (1, "a", 100, 0, 50)] and [r[4] for r in got if r[0] == 2] == [65536] * 4
    assert sum(r[4] for r in got if r[0] == 1) == 256 * 1024 and max(r[4] for r in got) == 65536


def test_reading_zeros_short_and_lost_chunks(spark):
    items = spark.createDataFrame([(1, EMPTY_FP, 0, 0, 3), (1, "a", 3, 1, 2), (2, "lost", 0, 0, 4)], ITEMS)
    stored = spark.createDataFrame([("a", bytearray(b"xyz"))], "fp string, chunk binary")
    ranges = spark.createDataFrame([(1, 1, 5), (2, 0, 2)], "block_id long, lo long, hi long")
    assert {r["block_id"]: r["data"] for r in mapping.read_range(items, stored, ranges).collect()} == {1: "0000" + b"yz".hex(), 2: None}


def cells(rows):
    return {(r["block_id"], r["item_start"] + k): (r["fp"], r["chunk_offset"] + k) for r in rows for k in range(r["item_size"])}


def test_merge_parts_against_cells(spark):
    rnd = random.Random(4)
    items = [(b, f"{b}-{k}", k * 20, rnd.randrange(9), 20) for b in range(6) for k in range(6) if rnd.random() < 0.8]
    jobs = [(s, rnd.randrange(3), 3 + rnd.randrange(3), rnd.randrange(90), rnd.randrange(60), rnd.randrange(1, 50)) for s in range(1, 9)]
    frame = spark.createDataFrame(items, ITEMS)
    before = cells(frame.collect())
    targets = {j[1 + 1] for j in jobs}
    want = {k: v for k, v in before.items() if k[0] in targets}
    for _, src, dst, a, b, n in jobs:
        want |= {(dst, b + k): before[src, a + k] for k in range(n) if (src, a + k) in before}
    got = mapping.merge_parts(frame, spark.createDataFrame(jobs, "seq long, src long, dst long, src_lo long, dst_lo long, size long"))
    assert cells(got.collect()) == want


def test_copy_steps_cross_no_border(spark):
    rnd = random.Random(6)
    jobs = [(k, rnd.randrange(500), rnd.randrange(500), rnd.randrange(0, 400)) for k in range(40)] + [(40, 64, 128, 64)]
    got = mapping.copy_steps(spark.createDataFrame(jobs, "job long, src_offset long, dst_offset long, size long"), 64).collect()
    by = {}
    for r in got:
        for c in ("src_offset", "dst_offset"):
            assert r["size"] > 0 and r[c] // 64 == (r[c] + r["size"] - 1) // 64
        by.setdefault(r["job"], []).append((r["src_offset"], r["dst_offset"], r["size"]))
    for k, src, dst, n in jobs:
        at = 0
        for s, t, m in sorted(by.get(k, [])):
            assert (s, t) == (src + at, dst + at)
            at += m
        assert at == n


def test_pair_diff_marks_the_first_occurrence(spark):
    frame = lambda fps: spark.createDataFrame([(1, k, f, n) for k, (f, n) in enumerate(fps)], "block_id long, pos long, fp string, size long")
    got = mapping.pair_diff(frame([("a", 5), ("b", 5), (EMPTY_FP, 9), ("z", 0)]), frame([("c", 5), ("a", 1), ("c", 2), ("z", 0)])).collect()
    assert sorted((r["fp"], -1 if r["pos"] is None else r["pos"], r["modifier"]) for r in got) == [("a", 1, 0), ("b", -1, -1), ("c", 0, 2), ("c", 2, 0)]


def test_equal_blocks_and_checksums(spark):
    a = spark.createDataFrame([(1, "a", 0, 0, 5), (1, "b", 5, 0, 5), (2, "a", 0, 0, 5)], ITEMS)
    b = spark.createDataFrame([(1, "b", 5, 0, 5), (1, "a", 0, 0, 5), (2, "a", 0, 1, 5), (3, "c", 0, 0, 1)], ITEMS)
    assert {r["block_id"]: r["equal"] for r in mapping.equal_blocks(a, b).collect()} == {1: True, 2: False, 3: False}
    sums = [{r["block_id"]: r["checksum"] for r in mapping.checksum(x).collect()} for x in (a, b)]
    assert sums[0][1] == sums[1][1] and sums[0][2] != sums[1][2]


def test_a_failed_container_fails_later_versions(spark):
    used = [(1, 1, 10), (1, 2, 11), (1, 3, 10), (2, 1, 10), (2, 2, 12), (2, 3, 10)]
    states = spark.createDataFrame([(10, "committed"), (11, "failed")], "container_id long, state string")
    got = storage.volatile_states(spark.createDataFrame(used, "block_id long, version long, container_id long"), states).collect()
    assert {(r["block_id"], r["version"]): r["state"] for r in got} == {(1, 1): "committed", (1, 2): "failed", (1, 3): "failed", (2, 1): "committed", (2, 2): "volatile", (2, 3): "volatile"}


def test_candidates_by_the_ladder(spark):
    candidates = spark.createDataFrame([("busy", "usage"), ("gone", "usage"), ("gone", "failed"), ("used", "failed"), ("free", "usage"), ("below", "usage")], "fp string, type string")
    counts = spark.createDataFrame([("busy", 0), ("used", 2), ("free", 0), ("below", -1)], "fp string, usage_count long")
    got = {(r["fp"], r["type"]): r["action"] for r in storage.process_candidates(candidates, counts, spark.createDataFrame([("busy",)], "fp string")).collect()}
    assert got == {("busy", "usage"): "keep", ("gone", "usage"): "drop", ("gone", "failed"): "keep", ("used", "failed"): "drop", ("free", "usage"): "delete", ("below", "usage"): "drop"}


def test_merged_containers_redirect_to_the_smallest_live_id(spark):
    items = spark.createDataFrame([(5, 5, True), (5, 5, True), (6, 6, False), (7, 7, False), (7, 3, False)], "container_id long, original_id long, deleted boolean")
    groups = spark.createDataFrame([(5, 1), (6, 1), (7, 1)], "container_id long, merge_group long")
    got = {r["original_id"]: (r["role"], r["primary_id"]) for r in storage.merge_containers(items, groups).collect()}
    assert got == {3: ("primary", 3), 5: ("removed", None), 6: ("secondary", 3), 7: ("secondary", 3)}


def test_repaired_index_has_no_violations(spark):
    from tests.test_core import stored_rows

    stored = stored_rows(spark, [(1, b"a"), (2, b"b"), (3, b"c")])
    a, b, c = [r["fp"] for r in stored.orderBy("address").collect()]
    items = spark.createDataFrame([(a, 1), (a, 1), (b, 2)], "fp string, address long")
    index = spark.createDataFrame([(a, 9, 5), (c, 3, 0)], "fp string, address long, usage_count long")
    got = storage.repair_index(index, items, stored)
    assert {tuple(r) for r in got.collect()} == {(a, 1, 2, True), (b, 2, 1, True), (c, 3, 0, False)}
    assert storage.violations(items, got.drop("repaired"), stored, spark.createDataFrame([(c,)], "fp string")).count() == 0


def test_chunks_by_volume_and_filters(spark):
    rows = [(1, 1, "s", 0, bytearray(b"x" * 20), 20), (2, 2, "s", 0, bytearray(b"y" * 20), 20)]
    writes = spark.createDataFrame(rows, "write_seq long, volume_id int, source string, offset long, data binary, size long")
    got = chunking.chunks_by_volume(writes, ("static", {"size": 8}), {2: ("static", {"size": 16})}).collect()
    assert sorted((r["volume_id"], r["size"]) for r in got) == [(1, 4), (1, 8), (1, 8), (2, 4), (2, 16)]
    assert chunking.chunks_by_volume(writes, ("static", {"size": 8}), {}).count() == 6
    assert dedup.filters_for(None) == ("block-index-filter", "chunk-index-filter")
    with pytest.raises(KeyError):
        dedup.filters_for(["nothing"])


def test_two_tiers(spark):
    main, aux = (spark.createDataFrame(x, "k long, v long") for x in ([(1, 1), (2, 2)], [(2, 9), (3, 3)]))
    assert {tuple(r) for r in dedup.two_tier(main, aux, "k").collect()} == {(1, 1), (2, 9), (3, 3)}


def test_locality_follows_a_copied_stream(spark):
    first = [(b, b, f"f{b}-{p}") for b in range(20) for p in range(4)]
    again = [(100 + b, 100 + b, f) for _, b, f in first]
    frame = spark.createDataFrame(first + again, "write_seq long, block_id long, fp string")
    got = locality.replay_locality(frame, segment=1000, warm=0).collect()
    # The first block seen again teaches the distance; every later one of the copy is found in the block that it leads to.
    assert {(r["block_id"], r["fp"], r["cached_block"]) for r in got} == {(b, f, b - 100) for _, b, f in again if b > 100}
    assert locality.replay_locality(frame, segment=100, warm=0).count() == 0
    warmed = locality.replay_locality(frame, segment=100, warm=100).collect()  # a segment that has replayed the one before finds the same
    assert {(r["block_id"], r["fp"]) for r in warmed} == {(r["block_id"], r["fp"]) for r in got}


def test_locality_bounds_and_prefetch():
    options = locality.LocalityOptions(blocks=2, distances=1, ahead=1)
    state = locality.LocalityState(options, written={1: frozenset("a"), 2: frozenset("b"), 3: frozenset("ca")})
    assert [state.bring(b) for b in (1, 2, 3, 9)] == [True, True, True, False] and list(state.at_hand) == [2, 3]
    assert state.lookup(50, set("abz")) == {"a": 3, "b": 2}
    state.settle(5, set("ab"), {"a": 3, "b": 2})  # distances -2 and -3 have one vote each, and one is remembered
    assert len(state.votes) == 1 and state.written[5] == frozenset("ab")
    state = locality.LocalityState(options, written={1: frozenset("a"), 2: frozenset("b"), 3: frozenset("c")}, votes={-3: 1})
    assert state.lookup(4, set("abc")) == {"a": 1, "b": 2} and state.brought == 2  # block 1 is brought in, and the one behind it
    assert list(locality.replayed([(1, 1, "x"), (1, 2, "x")], options)) == [(1, 1, {}), (1, 2, {})]


def test_locality_in_the_chain(spark):
    chunks = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (1, 10, "c")], "write_seq long, block_id long, fp string")
    found = spark.createDataFrame([(10, "a", 7)], "block_id long, fp string, cached_address long")
    index = spark.createDataFrame([("a", 1), ("b", 2)], "fp string, index_address long")
    names = ("block-locality-filter", "chunk-index-filter")
    out = dedup.chain(chunks, names, locality=found, index=index)
    assert {r["fp"]: (r["decision"], r["address"]) for r in out.collect()} == {"a": (3, 7), "b": (3, 2), "c": (1, None)}
    asked = {r["filter"]: (r["reads"], r["strong_hits"], r["misses"]) for r in dedup.counters(out, names).collect()}
    assert asked == {names[0]: (3, 1, 0), names[1]: (2, 1, 1)}


def test_ingest_again_changes_nothing(spark, tmp_path):
    from chunkwell.streaming import ingest

    rows = [(k, 1, "s", k * 4096, bytearray(bytes([k % 3]) * 100), 100) for k in range(24)]
    writes = spark.createDataFrame(rows, "write_seq long, volume_id int, source string, offset long, data binary, size long")
    stream = ingest.staged(writes, str(tmp_path), "write_seq", 8)
    for _ in range(2):
        index, items = ingest.ingest(stream, str(tmp_path), 64, 4096)
        assert index.count() == index.select("fp").distinct().count() == 6 and items.count() == 48


def test_a_failing_consumer_does_not_stop_the_others_and_loses_nothing(spark, tmp_path):
    from chunkwell.streaming import ingest

    events = spark.createDataFrame([(k, "t") for k in range(20)], "log_id long, event_type string")
    stream, calls = ingest.staged(events, str(tmp_path), "log_id"), []

    def flaky(batch):
        calls.append(1)
        return batch.select("nothing" if len(calls) == 2 else "log_id")

    consumers = {"bad": lambda b: b.select("nothing"), "flaky": flaky, "good": lambda b: b.select("log_id")}
    found = ingest.publish(stream, str(tmp_path), consumers)
    ids = lambda name: sorted(r[0] for r in found[name].select("log_id").collect())
    assert set(found) == {"flaky", "good"} and ids("good") == list(range(20)) and len(ids("flaky")) < 20
    found = ingest.publish(stream, str(tmp_path), consumers)
    assert ids("flaky") == ids("good") == list(range(20))


@pytest.mark.parametrize("codec", storage.CODECS)
def test_sealed_items_come_back_or_are_refused(spark, codec):
    data = {"empty": b"", "short": b"a" * 127, "even": b"ab" * 500, "random": random.Random(2).randbytes(1000)}
    chunks = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "fp string, chunk binary")
    sealed = chunks.mapInArrow(storage.seal(codec), storage.SEALED)
    rows = {r["fp"]: r for r in sealed.collect()}
    assert {k: r["codec"] for k, r in rows.items()} == {"empty": None, "short": None, "even": codec, "random": None}
    assert len(rows["even"]["stored"]) < 1000 and rows["random"]["raw_size"] == 1000
    back = storage.UNSEALED
    assert {r["fp"]: bytes(r["chunk"]) for r in sealed.mapInArrow(storage.unseal, back).collect()} == data
    hurt = sealed.where("fp = 'even'").withColumn("adler32", F.col("adler32") + 1)
    assert [(r["ok"], r["chunk"]) for r in hurt.mapInArrow(storage.unseal, back).collect()] == [(False, None)]


def test_unknown_codecs_are_refused():
    with pytest.raises(ValueError):
        storage.seal("none")
