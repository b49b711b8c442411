import random
import zlib

import pytest
from pyspark.sql import functions as F

from chunkwell.config import RabinOptions, irreducible, load, storage_unit, system
from chunkwell.functions import rabin
from chunkwell.functions.fingerprints import bloom_size, is_anchor, sample_mask
from chunkwell.operators import chunking, dedup, mapping, storage

P = RabinOptions().polynomial


def test_rabin_tables():
    t, u = rabin.append_table(P), rabin.drop_table(P, 48)
    assert (t[0], t[2], t[100], t[255]) == (0, 9209141382100228870, 4267581128949538325, 14665969062442009581)
    assert (u[0], u[2], u[100], u[255]) == (0, 7033709673330278438, 7551225361429087706, 1586646794406570246)


def rolled(data, options):
    """Cut points by a plain loop with a window buffer."""
    append, drop, mask = rabin.append_table(options.polynomial), rabin.drop_table(options.polynomial, options.window), options.average - 1
    out, start = [], 0
    while start < len(data):
        window, value, at, end = [0] * options.window, 0, 0, None
        for k in range(start + options.least - options.window, min(len(data), start + options.most)):
            value ^= drop[window[at]]
            window[at], at = data[k], (at + 1) % options.window
            value = ((value << 8 | data[k]) & (2**64 - 1)) ^ append[value >> 55]
            if value & mask == mask:
                end = k + 1
                break
        end = end or min(len(data), start + options.most)
        out.append(end)
        start = end
    return out


@pytest.mark.parametrize(("seed", "window"), [(0, 48), (1, 48), (2, 31), (3, 2), (4, 47)])
def test_rabin_cuts_equal_the_rolling_loop(seed, window):
    data = random.Random(seed).randbytes(60_000)
    options = RabinOptions(512, 128, 2048, window)
    assert [e for e, _ in rabin.cut_points(data, options)] == rolled(data, options)
    assert rabin.cut_points(bytes([7, 3]) * 32768) == [(32768, "max"), (65536, "max")]
    assert rabin.cut_points(b"") == []


def test_rabin_resists_shifts():
    data = random.Random(9).randbytes(65536)
    other = bytes(16) + data[16:]
    assert rabin.cut_points(data)[-1] == rabin.cut_points(other)[-1]


def rows(spark, data, offset=0):
    return spark.createDataFrame([(k, 1, "s", offset, bytearray(x), len(x)) for k, x in enumerate(data)], "write_seq long, volume_id int, source string, offset long, data binary, size long")


@pytest.mark.parametrize("offset,sizes", [(0, [8192] * 7 + [7656]), (1000, [7192] + [8192] * 7 + [464])])
def test_static_chunks(spark, offset, sizes):
    data = random.Random(1).randbytes(65000)
    got = chunking.static_chunks(rows(spark, [data], offset)).orderBy("chunk_no").collect()
    assert [r["size"] for r in got] == sizes
    assert b"".join(bytes(r["chunk"]) for r in got) == data


def test_rabin_chunks_join_to_the_input(spark):
    data = [random.Random(k).randbytes(20_000) for k in range(3)] + [b""]
    got = chunking.rabin_chunks(rows(spark, data), RabinOptions(512, 128, 2048)).orderBy("write_seq", "chunk_no").collect()
    for k, x in enumerate(data):
        joined = b"".join(bytes(r["chunk"]) for r in got if r["write_seq"] == k)
        assert zlib.adler32(joined) == zlib.adler32(x) and len(joined) == len(x)


def test_write_and_read_back(spark):
    data = [random.Random(k).randbytes(9000) for k in range(2)]
    w = rows(spark, data).withColumn("offset", __import__("pyspark.sql.functions", fromlist=["x"]).col("write_seq") * 65536 + 100)
    chunks = chunking.static_chunks(w, 512)
    items = mapping.block_items(chunks, 4096)
    pieces = chunking.split_blocks(w, 4096).collect()
    ranges = spark.createDataFrame([((1 << 47) | p["block"], p["block_offset"], p["block_offset"] + p["piece_size"]) for p in pieces], "block_id long, lo long, hi long")
    got = mapping.read_range(items, chunks.select("fp", "chunk").dropDuplicates(["fp"]), ranges).orderBy("block_id", "lo").collect()
    assert bytes.fromhex("".join(r["data"] for r in got)) == b"".join(data)


def test_overlay_against_cells(spark):
    rnd = random.Random(3)
    items = [(b, s, f"f{s}", rnd.randrange(200), rnd.randrange(5), rnd.randrange(1, 90)) for b in range(5) for s in range(12)]
    want = {}
    for b, s, f, start, off, n in sorted(items, key=lambda x: x[1]):
        for k in range(n):
            want[b, start + k] = (f, off + k)
    got = mapping.overlay(spark.createDataFrame(items, "block_id long, seq long, fp string, item_start long, chunk_offset long, item_size long")).collect()
    cells = {(r["block_id"], r["item_start"] + k): (r["fp"], r["chunk_offset"] + k) for r in got for k in range(r["item_size"])}
    assert cells == want


@pytest.mark.parametrize("after,want", [(["1", "20", "7"], {"20": 1}), (["20", "7"], {"20": 1, "1": -1}), (["1", "7", "7"], {"7": 1}), (["1", "7"], {})])
def test_usage_diff(spark, after, want):
    frame = lambda fps: spark.createDataFrame([(1, f) for f in fps], "block_id long, fp string")
    got = mapping.usage_diff(frame(["1", "7"]), frame([*after, "02"])).collect()
    assert {r["fp"]: r["delta"] for r in got} == want


def test_chain_rejects_repeats_and_keeps_addresses(spark):
    chunks = spark.createDataFrame([(1, "a"), (1, "b"), (1, "02")], "block_id long, fp string")
    prev = spark.createDataFrame([(1, "a", 5)], "block_id long, fp string, block_address long")
    index = spark.createDataFrame([("a", 9), ("c", 1)], "fp string, index_address long")
    got = {r["fp"]: (r["decision"], r["address"]) for r in dedup.chain(chunks, ("zerochunk-filter", "block-index-filter", "chunk-index-filter"), previous=prev, index=index).collect()}
    assert got == {"a": (3, 5), "b": (1, None), "02": (4, -2)}
    with pytest.raises(ValueError):
        dedup.chain(chunks, ("zerochunk-filter", "zerochunk-filter"))


def test_sampling_reads_the_last_four_bytes_least_first(spark):
    fps = ["00" * 16 + "1f000000", "00" * 16 + "0000001f", "00" * 16 + "ff000000"]
    df = spark.createDataFrame([(f,) for f in fps], "fp string")
    assert [r[0] for r in df.select(is_anchor(df.fp, 32)).collect()] == [True, False, True]
    assert (sample_mask(1), sample_mask(2), sample_mask(32)) == (1, 1, 31)
    assert bloom_size(1000, 0.01)[1] % 32 == 0


def test_replay_in_batches_equals_one_batch(spark, tmp_path):
    from chunkwell.streaming.replay import replay_counts

    rnd = random.Random(5)
    events = [(k, rnd.randrange(9), rnd.choice([-1, 1])) for k in range(300)]
    log = spark.createDataFrame(events + events[:50], "log_id long, fp long, delta long")  # some events come twice
    want = {}
    for _, f, x in events:
        want[f] = want.get(f, 0) + x
    batches = lambda: {p.name for p in (tmp_path / "replay-t" / "batches").glob("batch=*")}
    files = lambda: {p.name for p in (tmp_path / "replay-t" / "log").glob("*.parquet")}
    got = {r["fp"]: r["usage_count"] for r in replay_counts(spark, log, str(tmp_path), "t").collect()}
    before, held = batches(), files()
    assert got == want and len(before) > 1
    got = {r["fp"]: r["usage_count"] for r in replay_counts(spark, log, str(tmp_path), "t").collect()}
    assert got == want and batches() == before and files() == held  # the second call finds the position and reads nothing again
    more = log.unionByName(spark.createDataFrame([(900, 3, 5)], log.schema))
    got = {r["fp"]: r["usage_count"] for r in replay_counts(spark, more, str(tmp_path), "t").collect()}
    assert got == want | {3: want[3] + 5} and files() > held


def stored_rows(spark, rows):
    """(fp, address, chunk, deleted) of chunks that their own digests name."""
    import hashlib

    return spark.createDataFrame([(hashlib.sha1(c).hexdigest(), a, bytearray(c), False) for a, c in rows], "fp string, address long, chunk binary, deleted boolean")


def test_check_is_clean_or_names_the_fault(spark):
    stored = stored_rows(spark, [(1, b"a"), (2, b"b")])
    a, b = [r["fp"] for r in stored.orderBy("address").collect()]
    items = spark.createDataFrame([(a, 1), (a, 1), (b, 2)], "fp string, address long")
    index = lambda *r: spark.createDataFrame(list(r), "fp string, address long, usage_count long")
    listed = spark.createDataFrame([("z",)], "fp string")
    found = lambda *x: {tuple(r) for r in storage.violations(*x).collect()}
    assert found(items, index((a, 1, 2), (b, 2, 1)), stored, listed) == set()
    assert found(items, index((a, 1, 3)), stored, listed) == {("usage_count", a, "-1"), ("missing_index", b, "1"), ("item_not_indexed", b, "2")}
    good = index((a, 1, 2), (b, 2, 1))
    worse = stored.withColumn("chunk", F.when(F.col("address") == 1, F.encode(F.lit("A"), "UTF-8")).otherwise(F.col("chunk")))
    assert {k for k, *_ in found(items, good, worse, listed)} == {"rehash"}
    assert {k for k, *_ in found(items, index((a, 1, 2), (b, 7, 1)), stored, listed)} == {"wrong_address", "item_address", "missing_item"}
    assert found(items, index((a, 1, 2), (b, 2, 1), ("z", 0, 0), ("y", 0, 0)), stored, listed) == {("no_candidate", "y", "0"), ("missing_item", "z", "0"), ("missing_item", "y", "0")}
    gone = stored.withColumn("deleted", F.col("address") == 2)
    assert {k for k, *_ in found(items, good, gone, listed)} == {"missing_item"}


@pytest.mark.parametrize(("sizes", "offset", "ok"), [([60, 40], 0, True), ([60], 0, False), ([60, 0, 40], 0, False), ([60, 40], 65537, False), ([60, 41], 0, False), ([50, 60], 0, False)])
def test_mapping_check(spark, sizes, offset, ok):
    rows = [(1, k * 10, offset, n) for k, n in enumerate(sizes)]
    got = mapping.mapping_check(spark.createDataFrame(rows, "block_id long, item_start long, chunk_offset long, item_size long"), 100).collect()
    assert [(r["bytes"], r["ok"]) for r in got] == [(sum(sizes), ok)]
    large = spark.createDataFrame([(1, 0, 0, 70000)], "block_id long, item_start long, chunk_offset long, item_size long")
    assert not mapping.mapping_check(large, 70000).first()["ok"]


def test_byte_comparison_ladder(spark):
    """A chunk that cannot be read back equal is an error, whatever the fingerprint says."""
    chunks = [("same", b"xy"), ("other", b"xy"), ("short", b"xy"), ("lost", b"xy"), ("empty", b"xy"), ("new", b"xy"), ("elsewhere", b"xy"), ("none", None)]
    rows = spark.createDataFrame([(1, k, f, None if c is None else bytearray(c)) for k, (f, c) in enumerate(chunks)], "write_seq long, chunk_no long, fp string, chunk binary")
    index = spark.createDataFrame([(f, -2 if f == "empty" else 5) for f, _ in chunks if f != "new"], "fp string, index_address long")
    stored = spark.createDataFrame([("same", 5, bytearray(b"xy")), ("other", 5, bytearray(b"xz")), ("short", 5, bytearray(b"x")), ("elsewhere", 6, bytearray(b"xy"))], "fp string, stored_address long, stored_chunk binary")
    out = dedup.chain(rows, ("chunk-index-filter", "bytecompare-filter"), index=index, stored=stored)
    got = {r["fp"]: (r["decision"], r["address"], r["known"]) for r in out.collect()}
    bad = (0, None, False)
    assert got == {"same": (4, 5, True), "other": bad, "short": bad, "lost": bad, "elsewhere": bad, "empty": (4, -2, True), "new": (1, None, False), "none": (2, 5, True)}
    assert {r["fp"] for r in dedup.errors(out).collect()} == {"other", "short", "lost", "elsewhere"}
    after = {r["fp"] for r in dedup.learn(index.limit(0), out).collect()}
    assert after == {"new"}


def test_config():
    assert storage_unit("8K") == 8192 and storage_unit("10T") == 10 * 1024**4 and storage_unit("7") == 7
    assert load(["a=1 # x", "", "a = 2"]) == [("a", "1"), ("a", "2")]
    with pytest.raises(ValueError):
        RabinOptions(average=1000)
    with pytest.raises(ValueError, match="factors"):
        RabinOptions(polynomial=0xBFE6B8A5BF378D82)  # x divides it
    assert [p for p in range(2, 32) if irreducible(p)] == [2, 3, 7, 11, 13, 19, 25, 31]
    chunker, filters = system(load(["chunking=static", "chunking.size=4", "filter=bloom-filter", "filter=chunk-index-filter"]))
    assert filters == ("bloom-filter", "chunk-index-filter") and callable(chunker)
    for bad in ("colour=red", "filter=nothing", "chunking=nothing", "fingerprinting=nothing"):
        with pytest.raises((ValueError, KeyError)):
            system(load([bad]))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
