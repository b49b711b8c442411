"""Further queries: mapping algebra, index and container states, collection, versions, inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fingerprints import block_id
from ..functions.hashing import rot13
from ..operators import chunking, dedup, locality, mapping, storage
from ..sources import tables
from ..sources.shared import folder, kept
from ..streaming import ingest
from .queries import BLOCK, CHUNK, _chunks, _halves, _index, _items, _packed, _planted, _stored, query

# Functions


@query(r"""SELECT c_custkey AS k, lower(hex(encode(c_name))) AS as_hex, base64(encode(c_name)) AS as_base64,
       translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS as_rot13, c_name AS back FROM customer""")
def codecs(spark, d):
    c = tables.read(spark, d, "customer")
    raw, code = F.encode("c_name", "UTF-8"), F.base64(F.encode("c_name", "UTF-8"))
    return c.select(F.col("c_custkey").alias("k"), F.lower(F.hex(raw)).alias("as_hex"), code.alias("as_base64"), rot13(F.col("c_name")).alias("as_rot13"), F.decode(F.unbase64(code), "UTF-8").alias("back"))


# Volumes with their own chunker and filters


@query(""", x0 AS (SELECT page_id AS write_seq, page_id * 16777216 + 1000 AS off, hex(encode(coalesce(html, ''))) AS hx, octet_length(encode(coalesce(html, '')))::BIGINT AS total FROM pages),
       x1 AS (SELECT *, unnest(range(0, (off + total - 1) // 1024 - off // 1024 + 1)) AS chunk_no FROM x0 WHERE total > 0),
       x2 AS (SELECT *, greatest(0, (off // 1024 + chunk_no) * 1024 - off) AS start, least(total, (off // 1024 + chunk_no + 1) * 1024 - off) AS stop FROM x1)
       SELECT 2 AS volume_id, write_seq, chunk_no, stop - start AS size, md5(unhex(substr(hx, (2 * start + 1)::BIGINT, (2 * (stop - start))::BIGINT))) AS fp FROM x2
       UNION ALL SELECT 1, write_seq, chunk_no, size, fp FROM chunks""")
def chunks_per_volume(spark, d):
    """Documents on volume 1 by the default chunker, pages on volume 2 by their own."""
    both = tables.writes(spark, d).unionByName(tables.page_writes(spark, d))
    out = chunking.chunks_by_volume(both, ("static", {"size": CHUNK}), {2: ("static", {"size": 1024, "fp": "md5"})})
    return out.select("volume_id", "write_seq", "chunk_no", "size", "fp")


def _old_index(spark, d):
    old, new = _halves(spark, d)
    return dedup.chunk_index(old).select("fp", F.col("first_seq").alias("index_address")), new


_OLD = ", old AS (SELECT fp, min(write_seq) AS index_address FROM chunks WHERE write_seq % 2 = 0 GROUP BY fp) "


@query(_OLD + "SELECT write_seq, chunk_no, CASE WHEN index_address IS NULL THEN 1 ELSE 3 END AS decision, index_address AS address FROM chunks LEFT JOIN old USING (fp) WHERE write_seq % 2 = 1")
def volume_filter_subset(spark, d):
    """A volume that asks for the chunk index alone."""
    index, new = _old_index(spark, d)
    return dedup.chain(new, dedup.filters_for(["chunk-index-filter"]), index=index).select("write_seq", "chunk_no", "decision", "address")


@query(_OLD + "SELECT fp, index_address FROM old UNION ALL SELECT fp, min(write_seq) FROM chunks WHERE write_seq % 2 = 1 AND fp NOT IN (SELECT fp FROM old) GROUP BY fp")
def chain_update(spark, d):
    """The index after the second half of the requests went through the chain."""
    index, new = _old_index(spark, d)
    return dedup.learn(index, dedup.chain(new, ["chunk-index-filter"], index=index))


@query(", x AS (SELECT 1) SELECT count(*) AS items, capacity, count(*) < 0.9 * capacity AS accepting FROM idx, (SELECT unnest([100, 4000, 5000, 6000, 1000000000])::BIGINT AS capacity) GROUP BY capacity")
def index_admission(spark, d):
    """Whether an index with these items takes new chunks, for limits on either side of their number."""
    index, out = _index(spark, d), None
    for capacity in (100, 4000, 5000, 6000, 1_000_000_000):
        row = dedup.accepts_new(index, capacity)
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FROM orders GROUP BY o_custkey")
def two_tier_read(spark, d):
    main = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    aux = tables.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_totalprice", "o_orderkey").alias("v"))
    return dedup.two_tier(main, aux, "k")


def _near(spark, d):
    """Items of texts that were written twice, the second time some blocks further on: what a locality cache is for."""
    i = _items(spark, d).select("write_seq", "block_id", "fp")
    again = i.where("write_seq % 4 = 0").select((F.col("write_seq") + 1000).alias("write_seq"), (F.col("block_id") + 4096 * 1000).alias("block_id"), "fp")
    return i.unionByName(again)


@query()
def block_locality_cache(spark, d):
    """Which chunks the locality cache finds, and in which block."""
    return locality.replay_locality(_near(spark, d))


@query()
def locality_filter(spark, d):
    """The chain with the cache in it: a chunk that it finds is known before the index is asked."""
    near = _near(spark, d)
    found = locality.replay_locality(near).groupBy("block_id", "fp").agg(F.max("cached_block").alias("cached_address"))
    chunks = near.groupBy("write_seq", "block_id", "fp").agg(F.count(F.lit(1)).alias("n"))
    index = near.groupBy("fp").agg(F.min("block_id").alias("index_address")).where("fp < '8'")
    names = ("block-locality-filter", "chunk-index-filter")
    return dedup.counters(dedup.chain(chunks, names, locality=found, index=index), names)


# Mapping algebra


@query(", x AS (SELECT 1) SELECT block_id, fp, item_start, chunk_offset, least(item_size, 3000 - item_start) AS item_size FROM items WHERE item_start < 3000")
def mapping_cut(spark, d):
    return mapping.cut(_items(spark, d), 3000)


@query(""", e AS (SELECT block_id, min(item_start) AS lo, max(item_start + item_size) AS hi FROM items GROUP BY block_id)
       SELECT block_id, fp, item_start, chunk_offset, item_size FROM items UNION ALL SELECT block_id, '02', 0, 0, lo FROM e WHERE lo > 0 UNION ALL SELECT block_id, '02', hi, 0, 4096 - hi FROM e WHERE hi < 4096
       UNION ALL SELECT block_id + 1000000007, '02', 0, 0, 4096 FROM e""")
def mapping_fill_empty(spark, d):
    """Every block, and a block that was never written for each of them."""
    items = _items(spark, d)
    ids = items.select("block_id").distinct()
    return mapping.fill_empty(ids.unionAll(ids.select(F.col("block_id") + 1000000007)), items, BLOCK)


@query(", x AS (SELECT 1) SELECT ((1::BIGINT << 47) | off // 4096) AS block_id, 900 AS lo, 1100 AS hi, lower(repeat('00', 100) || rpad(substr(hx, 1, 200), 200, '0')) AS data FROM w WHERE total > 0")
def read_zero_filled(spark, d):
    """Reads over the border between nothing and the first byte of each request."""
    c, w = _chunks(spark, d), tables.writes(spark, d).where("size > 0")
    ranges = w.select(block_id(F.col("volume_id"), F.col("offset"), BLOCK).alias("block_id"), F.lit(900).alias("lo"), F.lit(1100).alias("hi"))
    items = mapping.fill_empty(ranges, mapping.block_items(c, BLOCK), BLOCK)
    return mapping.read_range(items, _stored(c), ranges)


@query(""", j0 AS (SELECT block_id AS src, block_id + 1 AS dst, greatest(min(item_start), 500) AS c0, least(max(item_start + item_size), 2700) AS c1 FROM items WHERE block_id % 2 = 0 GROUP BY block_id),
       j AS (SELECT *, CASE WHEN c0 < c1 THEN c0 + 400 ELSE 0 END AS d0, CASE WHEN c0 < c1 THEN c1 + 400 ELSE 0 END AS d1 FROM j0), i AS (SELECT *, item_start + item_size AS fin FROM items)
       SELECT dst AS block_id, fp, greatest(item_start, c0) + 400 AS item_start, chunk_offset + greatest(item_start, c0) - item_start AS chunk_offset, least(fin, c1) - greatest(item_start, c0) AS item_size FROM j JOIN i ON src = block_id AND item_start < c1 AND fin > c0 WHERE c0 < c1
       UNION ALL SELECT dst, fp, item_start, chunk_offset, least(fin, d0) - item_start FROM j JOIN i ON dst = block_id WHERE item_start < d0
       UNION ALL SELECT dst, fp, greatest(item_start, d1), chunk_offset + greatest(item_start, d1) - item_start, fin - greatest(item_start, d1) FROM j JOIN i ON dst = block_id WHERE fin > d1""")
def mapping_merge_parts(spark, d):
    """A slice of each even block goes over the odd block after it."""
    items = _items(spark, d)
    ids = items.select(F.col("block_id").alias("src")).distinct().where("src % 2 = 0")
    one = lambda n: F.lit(n).cast("long")
    return mapping.merge_parts(items, ids.select(one(1).alias("seq"), "src", (F.col("src") + 1).alias("dst"), one(500).alias("src_lo"), one(900).alias("dst_lo"), one(2200).alias("size")))


@query(""", p AS (SELECT write_seq, 0 AS p FROM w WHERE total > 0 UNION SELECT write_seq, unnest(range(off // 4096 + 1, (off + total - 1) // 4096 + 1)) * 4096 - off FROM w WHERE total > 0
       UNION SELECT write_seq, unnest(range((off + 777) // 4096 + 1, (off + 777 + total - 1) // 4096 + 1)) * 4096 - off - 777 FROM w WHERE total > 0)
       SELECT write_seq AS job, off + p AS src_offset, off + 777 + p AS dst_offset, coalesce(lead(p) OVER (PARTITION BY write_seq ORDER BY p), total) - p AS size FROM p JOIN w USING (write_seq)""")
def range_copy_steps(spark, d):
    """Every request copied 777 bytes further."""
    jobs = tables.writes(spark, d).select(F.col("write_seq").alias("job"), F.col("offset").alias("src_offset"), (F.col("offset") + 777).alias("dst_offset"), "size")
    return mapping.copy_steps(jobs, BLOCK)


@query(""", o AS (SELECT write_seq // 2 AS block_id, fp, count(*) AS n FROM chunks WHERE write_seq % 2 = 0 GROUP BY ALL), nw AS (SELECT write_seq // 2 AS block_id, fp, chunk_no AS pos, size FROM chunks WHERE write_seq % 2 = 1),
       f AS (SELECT block_id, fp, min(pos) AS p, count(*) AS n FROM nw GROUP BY ALL)
       SELECT nw.block_id, nw.pos, nw.fp, nw.size, CASE WHEN nw.pos = f.p THEN f.n - coalesce(o.n, 0) ELSE 0 END AS modifier FROM nw JOIN f ON f.block_id = nw.block_id AND f.fp = nw.fp LEFT JOIN o ON o.block_id = nw.block_id AND o.fp = nw.fp
       UNION ALL SELECT o.block_id, NULL, o.fp, 0, -o.n FROM o LEFT JOIN f ON f.block_id = o.block_id AND f.fp = o.fp WHERE f.fp IS NULL AND o.fp <> '02'""")
def mapping_pair_diff(spark, d):
    version = lambda c: c.select(F.floor(F.col("write_seq") / 2).alias("block_id"), F.col("chunk_no").alias("pos"), "fp", "size")
    return mapping.pair_diff(*map(version, _halves(spark, d)))


@query(", x AS (SELECT 1) SELECT block_id, bool_and(fp >= '1') AS equal FROM items GROUP BY block_id")
def mapping_equal(spark, d):
    """Blocks against a copy in which some items name another chunk."""
    items = _items(spark, d)
    return mapping.equal_blocks(items, items.withColumn("fp", F.when(F.col("fp") < "1", F.lit("x")).otherwise(F.col("fp"))))


@query(", x AS (SELECT 1) SELECT block_id, sha256(string_agg(item_start || ':' || item_size || ':' || fp || ':' || chunk_offset, ',' ORDER BY item_start, item_size, fp, chunk_offset)) AS checksum FROM items GROUP BY block_id")
def mapping_checksum(spark, d):
    return mapping.checksum(_items(spark, d))


# Collection

_COUNTS = ", c AS (SELECT fp, sum(delta)::BIGINT AS usage_count FROM logt GROUP BY fp), third AS (SELECT c_custkey AS fp FROM customer WHERE c_custkey % 3 = 0) "


def _counts(spark, d):
    return storage.usage_counts(tables.log(spark, d)).select("fp", "usage_count")


def _third(spark, d):
    return tables.read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("fp"))


@query(", x AS (SELECT 1) SELECT DISTINCT fp FROM logt WHERE log_id > 500")
def in_combat_set(spark, d):
    return storage.in_combat(tables.log(spark, d), 500)


@query(_COUNTS + "SELECT fp, usage_count, 'failed' AS type FROM c WHERE usage_count <= 0 AND fp IN (SELECT fp FROM third)")
def gc_orphans(spark, d):
    return storage.orphans(_third(spark, d), _counts(spark, d))


@query(_COUNTS + ", u AS (SELECT DISTINCT fp FROM logt WHERE event_type = 'signup') SELECT fp, 'failed' AS type FROM u WHERE fp NOT IN (SELECT fp FROM c WHERE fp % 4 <> 0 AND usage_count > 0)")
def gc_failed_candidates(spark, d):
    """Signups fail; the index lacks every fourth fingerprint."""
    return storage.failed_candidates(tables.log(spark, d).where("event_type = 'signup'"), _counts(spark, d).where("fp % 4 <> 0"))


@query(_COUNTS + "SELECT fp // 100 AS container_id, 'usage' AS type, string_agg(fp::VARCHAR, ',' ORDER BY fp) AS fps FROM c WHERE usage_count <= 0 GROUP BY 1")
def gc_candidate_lists(spark, d):
    found = _counts(spark, d).where("usage_count <= 0").select(F.floor(F.col("fp") / 100).alias("container_id"), "fp", F.lit("usage").alias("type"))
    return storage.candidate_lists(found.unionAll(found)).withColumn("fps", F.array_join(F.col("fps").cast("array<string>"), ","))


@query(_COUNTS + """, k AS (SELECT fp, 'usage' AS type FROM c WHERE usage_count <= 1 UNION ALL SELECT fp, 'failed' FROM third), i AS (SELECT fp, usage_count FROM c WHERE fp % 7 <> 0), busy AS (SELECT DISTINCT fp FROM logt WHERE log_id > 900)
       SELECT fp, type, usage_count, CASE WHEN fp IN (SELECT fp FROM busy) OR (usage_count IS NULL AND type = 'failed') THEN 'keep' WHEN usage_count IS NULL OR usage_count <> 0 THEN 'drop' ELSE 'delete' END AS action FROM k LEFT JOIN i USING (fp)""")
def gc_process_candidates(spark, d):
    """Candidates of both types against an index that lacks every seventh fingerprint."""
    counts = _counts(spark, d)
    candidates = counts.where("usage_count <= 1").select("fp", F.lit("usage").alias("type")).unionAll(_third(spark, d).select("fp", F.lit("failed").alias("type")))
    return storage.process_candidates(candidates, counts.where("fp % 7 <> 0"), storage.in_combat(tables.log(spark, d), 900))


@query(", x AS (SELECT 1) SELECT fp, max(log_id) AS change_log_id, arg_max(block_id, log_id) AS block_hint FROM logt WHERE fp % 2 = 1 GROUP BY fp")
def none_gc_hints(spark, d):
    return storage.anchor_hints(tables.log(spark, d), F.col("fp") % 2 == 1)


# Versions of blocks


@query(""", m AS (SELECT fp AS block_id, log_id AS version, log_id // 10 AS c FROM logt UNION ALL SELECT fp, log_id, log_id // 10 + 1 FROM logt),
       s AS (SELECT block_id, version, bool_or(c % 170 = 3) AS failed, bool_and(c % 170 <> 3 AND c % 130 <> 5) AS done FROM m GROUP BY ALL)
       SELECT block_id, version, CASE WHEN bool_or(failed) OVER v THEN 'failed' WHEN bool_and(done) OVER v THEN 'committed' ELSE 'volatile' END AS state FROM s WINDOW v AS (PARTITION BY block_id ORDER BY version)""")
def volatile_commit(spark, d):
    """Every version of a block uses two containers; some of those failed, some are still open."""
    log = tables.log(spark, d)
    used = lambda k: log.select(F.col("fp").alias("block_id"), F.col("log_id").alias("version"), (F.floor(F.col("log_id") / 10) + k).alias("container_id"))
    both = used(0).unionAll(used(1))
    state = F.when(F.col("container_id") % 170 == 3, "failed").when(F.col("container_id") % 130 != 5, "committed")
    return storage.volatile_states(both, both.select("container_id").distinct().select("container_id", state.alias("state")).where("state is not null"))


@query("""WITH a AS (SELECT o_custkey AS k, arg_max(o_orderkey % 7, o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY o_custkey), r AS (SELECT * FROM a WHERE k % 4 <> 0),
       m AS (SELECT c_custkey AS k, c_custkey % 5 AS version, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), f AS (SELECT r.* FROM r LEFT JOIN m USING (k) WHERE m.version IS NULL OR m.version < r.version)
       SELECT * FROM f UNION ALL SELECT * FROM m WHERE k NOT IN (SELECT k FROM f)""")
def mapping_import(spark, d):
    """Auxiliary mappings move to the main table where their version is the ready one and newer."""
    main = tables.read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 5).alias("version"), F.col("c_acctbal").alias("v"))
    last = tables.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by(F.struct((F.col("o_orderkey") % 7).alias("version"), F.col("o_totalprice").alias("v")), "o_orderkey").alias("a"))
    aux = last.select("k", "a.*")
    return storage.import_ready(main, aux, aux.select("k", F.when(F.col("k") % 4 == 0, F.col("version") + 1).otherwise(F.col("version")).alias("version")), "k")


# Containers


def _indexed_items(spark, d):
    moved = F.when(F.substring("fp", 2, 1) == "0", F.col("container_id") + 1).otherwise(F.col("container_id"))
    return _packed(spark, d).select("fp", "container_id", moved.alias("original_id"), (F.col("fp") >= "e").alias("deleted"), (F.col("fp") < "c").alias("indexed"))


@query(", x AS (SELECT 1) SELECT fp, CASE WHEN fp < '5' THEN 0 ELSE container_id END AS address, CASE WHEN fp < '5' THEN 7 ELSE 0 END AS usage_count FROM packed WHERE fp < '5' OR (fp < 'c' AND substr(fp, 2, 1) <> '0')")
def container_load(spark, d):
    """After a crash the index knows the fingerprints below 5; containers bring the rest of the live, indexed ones."""
    index = _packed(spark, d).where("fp < '5'").select("fp", F.lit(0).cast("long").alias("address"), F.lit(7).cast("long").alias("usage_count"))
    return storage.load_containers(index, _indexed_items(spark, d))


@query(""", k AS (SELECT container_id // 4 AS merge_group, container_id AS original_id, sum(CASE WHEN fp >= 'fc' THEN 1 ELSE 0 END)::BIGINT AS live_items FROM packed GROUP BY ALL),
       p AS (SELECT merge_group, min(original_id) AS p FROM k WHERE live_items > 0 GROUP BY 1)
       SELECT merge_group, original_id, live_items, CASE WHEN live_items > 0 THEN p END AS primary_id, CASE WHEN original_id = p THEN 'primary' WHEN live_items > 0 THEN 'secondary' ELSE 'removed' END AS role FROM k LEFT JOIN p USING (merge_group)""")
def container_merge(spark, d):
    items = _packed(spark, d).select("container_id", F.col("container_id").alias("original_id"), (F.col("fp") < "fc").alias("deleted"))
    groups = items.select("container_id").distinct().withColumn("merge_group", F.floor(F.col("container_id") / 4))
    return storage.merge_containers(items, groups)


@query(", x AS (SELECT 1) SELECT container_id FROM packed GROUP BY container_id HAVING max(fp) < 'fd'")
def container_delete_empty(spark, d):
    packed = _packed(spark, d)
    return storage.delete_items(packed, packed.where("fp < 'fd'").select("fp")).where("active_items = 0").select("container_id")


@query(", t AS (SELECT log_id // 50 AS container_id, max(epoch_us(ts)) AS last FROM logt GROUP BY 1) SELECT container_id, (SELECT max(last) FROM t) - last > 86400000000 AS commit FROM t")
def container_timeouts(spark, d):
    writes = tables.log(spark, d).select(F.floor(F.col("log_id") / 50).alias("container_id"), F.col("ts").cast("timestamp").alias("ts"))
    return storage.idle_containers(writes, 86400)


@query(", p AS (SELECT fp, min(hex(piece)) AS h FROM chunks GROUP BY fp) SELECT fp, CASE WHEN fp >= '4' THEN lower(substr(h, 201, 400)) END AS data FROM p")
def container_read_items(spark, d):
    """Bytes 100 to 300 of every stored chunk; those below 4 are deleted."""
    chunks = _stored(_chunks(spark, d))
    stored = chunks.select("fp", F.lit(1).alias("address"), "chunk", (F.col("fp") < "4").alias("deleted"))
    return storage.read_items(_index(spark, d).select("fp", F.lit(1).alias("address"), F.lit(100).alias("lo"), F.lit(200).alias("n")), stored)


@query(""", u AS (SELECT items.fp, min(container_id) AS address, count(*) AS n FROM items JOIN packed USING (fp) GROUP BY items.fp)
       SELECT fp, address, CASE WHEN substr(fp, 1, 2) = '44' THEN 0 ELSE n END AS usage_count, substr(fp, 1, 2) IN ('00', '11', '22') AS repaired FROM u""")
def check_repairs(spark, d):
    """The index with planted faults, repaired from containers and block items."""
    items, index, stored, _ = _planted(spark, d)
    return storage.repair_index(index, items, stored)


@query(""", k AS (SELECT unnest(['deflate', 'bz2', 'snappy', 'lz4']) AS codec) SELECT codec, count(*) AS items, count(*) FILTER (fp < '1') AS damaged, count(*) FILTER (fp >= 'f') AS different FROM k, idx GROUP BY codec""")
def container_codecs(spark, d):
    """All stored chunks sealed by each codec in one pass and read back: some with a checksum that was damaged (below 1), some of other bytes (from f on)."""
    more = F.when(F.col("fp") >= "f", F.concat("chunk", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("chunk"))
    sealed = _stored(_chunks(spark, d)).select("fp", more.alias("chunk")).mapInArrow(storage.seal(*storage.CODECS), storage.SEALED)
    sealed = sealed.withColumn("adler32", F.when(F.col("fp") < "1", F.col("adler32") + 1).otherwise(F.col("adler32")))
    back = sealed.mapInArrow(storage.unseal, storage.UNSEALED)
    wrong = F.col("ok") & (F.sha1("chunk") != F.col("fp"))
    return back.groupBy(F.col("asked").alias("codec")).agg(F.count(F.lit(1)).alias("items"), F.sum((~F.col("ok")).cast("long")).alias("damaged"), F.sum(wrong.cast("long")).alias("different"))


# Inspection and log


@query(", x AS (SELECT 1) SELECT fp, first_seq, first_no, size, usage_count FROM idx")
def inspect_chunks(spark, d):
    """Index rows of all chunks, by the request that brought them."""
    return _index(spark, d).select("fp", "first_seq", "first_no", "size", "usage_count")


@query(", x AS (SELECT 1) SELECT container_id, CASE WHEN container_id % 3 = 0 THEN 'committed' WHEN container_id <= 20 THEN 'never' ELSE 'open' END AS state, fp, size FROM packed")
def inspect_container(spark, d):
    """All containers' items, with the commit state of each."""
    packed = kept(_packed(spark, d), "inspected")
    ids = packed.select(F.col("container_id").alias("address")).distinct()
    state = storage.commit_state(ids, ids.select(F.col("address").alias("container_id")).where("container_id % 3 = 0"), 20)
    return packed.join(state.withColumnRenamed("address", "container_id"), "container_id").select("container_id", "state", "fp", "size")


@query(", x AS (SELECT 1) SELECT log_id, event_type, fp, delta FROM logt WHERE log_id >= 900")
def log_active(spark, d):
    """Events that are not replayed yet."""
    return tables.log(spark, d).where("log_id >= 900").select("log_id", "event_type", "fp", "delta")


@query(", x AS (SELECT 1) SELECT 'dedup.chunks' AS key, sum(usage_count)::BIGINT AS value FROM idx UNION ALL SELECT 'dedup.distinct_chunks', count(*) FROM idx UNION ALL SELECT 'dedup.logical_bytes', sum(usage_count * size)::BIGINT FROM idx UNION ALL SELECT 'dedup.physical_bytes', sum(size)::BIGINT FROM idx")
def stats_table(spark, d):
    """Counters as rows under prefixed keys, the form in which they are kept and found again."""
    r = dedup.ratio(_chunks(spark, d)).drop("dedup_ratio")
    return r.unpivot([], r.columns, "name", "value").select(F.concat(F.lit("dedup."), F.col("name")).alias("key"), "value")


# Streams


@query(", x AS (SELECT 1) SELECT fp, size FROM idx")
def stream_ingest(spark, d):
    """The index that writes leave when they arrive in micro-batches."""
    where = folder(spark, "ingest")
    index, _ = ingest.ingest(ingest.staged(tables.writes(spark, d), where, "write_seq"), where, CHUNK, BLOCK)
    return index.select("fp", "size")


@query(", x AS (SELECT 1) SELECT event_type, count(*) AS events, max(log_id) AS last_id FROM logt GROUP BY event_type")
def stream_publish(spark, d):
    """One of two consumers of the log counts its events; partial counts of batches are summed."""
    where = folder(spark, "publish")
    count = lambda b: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.max("log_id").alias("last_id"))
    consumers = {"counts": count, "hints": lambda b: b.select("log_id", "fp", "block_id")}
    found = ingest.publish(ingest.staged(tables.log(spark, d), where, "log_id"), where, consumers)["counts"]
    return found.groupBy("event_type").agg(F.sum("events").alias("events"), F.max("last_id").alias("last_id"))
