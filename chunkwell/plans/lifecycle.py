"""Queries on what happens to blocks, volumes, containers and the log over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing_sql
from ..functions.fingerprints import bloom_size, block_id
from ..functions.hashing import murmur3_batches, murmur3_wide
from ..config import SAMPLERS
from ..operators import blocks, chunking, containers, dedup, events, mapping, metrics, storage, volumes
from ..schemas import BLOCK_SHIFT
from ..sources import tables
from ..sources.shared import folder, kept
from ..streaming import ingest
from ..streaming.replay import EventLog
from .queries import BLOCK, CHUNK, CONTAINER, _chunks, _index, _items, _packed, _state, _stored, query

X = ", x AS (SELECT 1) "

# Hashes


def _fps(spark, d):
    return _index(spark, d).select("fp", F.unhex("fp").alias("raw"))


@query(X + hashing_sql.murmur32("idx", "fp", "fp", 20, "f3::BIGINT AS hash, (f3 % 16)::BIGINT AS shard"))
def murmur3_shards(spark, d):
    """The shard of 16 that each chunk's fingerprint belongs to."""
    keys = _fps(spark, d).mapInArrow(murmur3_batches, "fp string, murmur3 long")
    return keys.select("fp", F.col("murmur3").alias("hash"), (F.col("murmur3") % 16).alias("shard"))


@query(X + hashing_sql.murmur128("idx", "fp", "fp", f"{hashing_sql.signed('low')} AS low, {hashing_sql.signed('high')} AS high"))
def murmur3_x64_128(spark, d):
    wide = "fp string, low long, high long, w0 long, w1 long, w2 long, w3 long"
    return _fps(spark, d).mapInArrow(murmur3_wide, wide).select("fp", "low", "high")


@query(X + hashing_sql.murmur128_words("idx", "fp", "fp", ", ".join(f"w{k}::BIGINT AS w{k}" for k in range(4))))
def murmur3_x86_128(spark, d):
    wide = "fp string, low long, high long, w0 long, w1 long, w2 long, w3 long"
    return _fps(spark, d).mapInArrow(murmur3_wide, wide).select("fp", "w0", "w1", "w2", "w3")


@query(X + hashing_sql.xx64("idx", "fp", "fp", 42, f"{hashing_sql.signed('e2')} AS hash"))
def xxhash64(spark, d):
    """The 64-bit hash that takes the place of the second sharding hash."""
    return _fps(spark, d).select("fp", F.xxhash64("raw").alias("hash"))


@query(X + """, b AS (SELECT write_seq, total, unnest(range(0, total)) AS i, hx FROM w WHERE total > 0),
       v AS (SELECT write_seq, total, i, ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT AS byte FROM b),
       a AS (SELECT write_seq, ((total + sum((total - i) * byte)) % 65521)::BIGINT AS hi, ((1 + sum(byte)) % 65521)::BIGINT AS lo FROM v GROUP BY write_seq, total)
       SELECT write_seq AS key, hi * 65536 + lo AS adler32 FROM a UNION ALL SELECT write_seq, 1 FROM w WHERE total = 0""")
def adler32(spark, d):
    return tables.writes(spark, d).select(F.col("write_seq").alias("key"), "data").mapInArrow(storage.adler32, "key long, adler32 long")


@query(""", bit0 AS (SELECT i AS t, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT t, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bit0 WHERE k < 8),
       tab AS (SELECT list(c ORDER BY t) AS l FROM bit0 WHERE k = 8),
       step AS (SELECT write_seq, chunk_no, hex(piece) AS h, size, 0 AS i, 4294967295::BIGINT AS c FROM chunks
                UNION ALL SELECT write_seq, chunk_no, h, size, i + 1, xor(c // 256, l[(xor(c, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) % 256) + 1]) FROM step, tab WHERE i < size)
       SELECT write_seq, chunk_no, xor(c, 4294967295) AS crc32 FROM step WHERE i = size""")
def crc32(spark, d):
    return _chunks(spark, d).select("write_seq", "chunk_no", F.crc32("chunk").alias("crc32"))


@query(X + "SELECT fp, true AS indexed FROM idx")
def sampling_full(spark, d):
    """Without sampling every chunk is an anchor."""
    return _index(spark, d).select("fp", SAMPLERS.get("full")(F.col("fp")).alias("indexed"))


@query("""WITH n AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), h AS (SELECT k, n, 1.0 / (8 * (k + 2)) AS e FROM n), c AS (SELECT *, ceil(log2(1 / e))::BIGINT AS hashes FROM h),
       p AS (SELECT *, ceil(2 * n * abs(ln(e)) / (hashes * ln(2) ** 2))::BIGINT AS per FROM c) SELECT k, n, hashes, ((hashes * per + 31) // 32 * 32)::BIGINT AS bits FROM p""")
def bloom_sizes(spark, d):
    """Hash functions and bits of a membership set for each nation's customers, at error rates from 1/16 down."""
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("hashes", T.LongType()), T.StructField("bits", T.LongType())])
    size = F.udf(lambda n, k: bloom_size(n, 1 / (8 * (k + 2))), kind)  # one row a nation
    n = tables.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("s", size("n", "k")).select("k", "n", "s.hashes", "s.bits")


# Blocks

_TIERS = """, prev AS (SELECT write_seq // 2 AS block_id, 1 + (write_seq // 2) % 3 AS version, fp, size % 7 + 1 AS data_address FROM chunks WHERE write_seq % 2 = 0 AND write_seq % 6 <> 0),
upd AS (SELECT write_seq // 2 AS block_id, fp, size % 7 + 1 AS data_address FROM chunks WHERE write_seq % 2 = 1) """


def _tiers(spark, d):
    """Even requests are what blocks held before (some are new), odd ones what is written to them."""
    c = _chunks(spark, d).select("write_seq", F.floor(F.col("write_seq") / 2).alias("block_id"), "fp", (F.col("size") % 7 + 1).alias("data_address"))
    old = c.where("write_seq % 2 = 0 and write_seq % 6 <> 0").withColumn("version", 1 + F.col("block_id") % 3)
    return old.drop("write_seq"), c.where("write_seq % 2 = 1").drop("write_seq")


@query(_TIERS + """, o AS (SELECT block_id, max(version) AS ov, count(DISTINCT fp) FILTER (fp <> '02') AS in_combat FROM prev GROUP BY 1),
       n AS (SELECT block_id, count(*) AS items, count(DISTINCT data_address) AS containers FROM upd GROUP BY 1),
       b AS (SELECT n.block_id, coalesce(ov, 0) + 1 AS version, items, containers, coalesce(in_combat, 0) AS in_combat FROM n LEFT JOIN o USING (block_id)),
       k AS (SELECT *, CASE WHEN version = 1 THEN row_number() OVER (PARTITION BY version = 1 ORDER BY block_id) END AS nth FROM b),
       s AS (SELECT *, CASE WHEN nth > 400 - (SELECT count(DISTINCT block_id) FROM prev) THEN 'full' ELSE 'written' END AS state FROM k)
       SELECT block_id, version, state, CASE WHEN state = 'written' THEN 1000 + row_number() OVER (PARTITION BY state ORDER BY block_id) END AS log_id, items, containers, in_combat FROM s""")
def block_store(spark, d):
    """Written events of all blocks, for an index with room for 400."""
    old, new = _tiers(spark, d)
    return blocks.store_blocks(old, new, old.select("block_id", "version").distinct(), 400, 1000)


@query(X + """, e AS (SELECT block_id, min(item_start) AS lo, max(item_start + item_size) AS hi FROM items GROUP BY block_id)
       SELECT block_id, CASE block_id % 5 WHEN 0 THEN fp WHEN 1 THEN 'aux' ELSE 'main' END AS fp, item_start, chunk_offset, item_size FROM items WHERE block_id % 5 <> 4
       UNION ALL SELECT block_id, '02', 0, 0, lo FROM e WHERE lo > 0 AND block_id % 5 <> 4 UNION ALL SELECT block_id, '02', hi, 0, 4096 - hi FROM e WHERE hi < 4096 AND block_id % 5 <> 4
       UNION ALL SELECT block_id, '02', 0, 0, 4096 FROM e WHERE block_id % 5 = 4""")
def block_read(spark, d):
    """All blocks through the session, the auxiliary and the main tier; a fifth of them is in none."""
    i = _items(spark, d)
    tier = lambda where, fp: i.where(where).withColumn("fp", fp)
    session, aux, main = tier("block_id % 5 = 0", F.col("fp")), tier("block_id % 5 in (0, 1)", F.lit("aux")), tier("block_id % 5 <> 4", F.lit("main"))
    return blocks.read_blocks(i.select("block_id"), session, aux, main, BLOCK)


@query(X + "SELECT block_id, CASE WHEN bool_or(fp >= 'fe') THEN NULL ELSE sum(item_size)::BIGINT END AS bytes FROM items GROUP BY block_id")
def block_read_by_address(spark, d):
    """Every block read from its items' addresses; chunks from fe on are stored at another one, so what holds them cannot be read."""
    c = _chunks(spark, d)
    place = F.pmod(F.crc32(F.col("fp").cast("binary")), F.lit(7))
    items = mapping.block_items(c, BLOCK).withColumn("data_address", place)
    stored = _stored(c).withColumn("data_address", place + (F.col("fp") >= "fe").cast("long"))
    ranges = items.groupBy("block_id").agg(F.min("item_start").alias("lo"), F.max(F.col("item_start") + F.col("item_size")).alias("hi"))
    return mapping.read_range(items, stored, ranges).select("block_id", F.floor(F.length("data") / 2).alias("bytes"))


@query(_TIERS + """, asked AS (SELECT DISTINCT write_seq // 2 AS block_id FROM w), aux AS (SELECT block_id, fp FROM upd WHERE block_id % 3 = 0),
       held AS (SELECT * FROM aux UNION ALL SELECT block_id, fp FROM prev WHERE block_id NOT IN (SELECT block_id FROM aux)),
       s AS (SELECT block_id, CASE WHEN block_id % 7 = 0 THEN 'volatile' WHEN block_id IN (SELECT block_id FROM held) THEN 'deleted' ELSE 'not_found' END AS outcome FROM asked),
       u AS (SELECT block_id, fp, -count(*) AS delta FROM held WHERE fp <> '02' GROUP BY 1, 2)
       SELECT s.block_id, outcome, fp, delta FROM s LEFT JOIN u ON u.block_id = s.block_id AND outcome = 'deleted'""")
def block_delete(spark, d):
    """All blocks are to be deleted; every seventh is volatile, some are in no tier."""
    old, new = _tiers(spark, d)
    asked = tables.writes(spark, d).select(F.floor(F.col("write_seq") / 2).alias("block_id"))
    return blocks.delete_blocks(asked, old, new.where("block_id % 3 = 0"), asked.where("block_id % 7 = 0"))


@query("""WITH f AS (SELECT c_custkey AS k, c_custkey % 4 + 1 AS version, c_custkey + 7 AS lid FROM customer), a AS (SELECT k, CASE WHEN k % 3 > 0 THEN k % 5 + 1 END AS a, CASE WHEN k % 2 = 0 THEN k % 4 + 1 + k % 8 // 4 END AS m FROM f)
       SELECT k AS block_id, version, lid AS event_log_id, version - 1 AS data_version FROM f JOIN a USING (k) WHERE a = version OR (a IS NULL AND (m IS NULL OR m = version))""")
def block_write_failed(spark, d):
    """A write to each block fails; tiers hold the failed version, a later one or none."""
    k = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("block_id"))
    failed = k.select("block_id", (F.col("block_id") % 4 + 1).alias("version"), (F.col("block_id") + 7).alias("write_log_id"))
    aux = k.where("block_id % 3 > 0").withColumn("version", F.col("block_id") % 5 + 1)
    main = k.where("block_id % 2 = 0").withColumn("version", F.col("block_id") % 4 + 1 + F.floor(F.col("block_id") % 8 / 4))
    return blocks.fail_writes(failed, aux, main)


@query("""WITH e AS (SELECT o_orderkey AS log_id, o_custkey AS block_id, o_orderkey % 7 + 1 AS version, o_orderkey % 11 = 0 AS broken, o_orderkey % 13 = 0 AS open FROM orders),
       r AS (SELECT *, CASE WHEN block_id % 3 <> 0 THEN block_id % 5 END AS m, CASE WHEN block_id % 4 <> 0 THEN block_id % 6 END AS a, CASE WHEN block_id % 4 <> 0 THEN CASE WHEN block_id % 5 = 0 THEN 0 ELSE block_id * 8 END END AS a_log FROM e),
       k AS (SELECT *, bool_or(broken) OVER (PARTITION BY block_id, version) AS b, bool_or(open) OVER (PARTITION BY block_id, version) AS o FROM r),
       bg AS (SELECT log_id, block_id, version, a, CASE WHEN a IS NULL THEN 'skip_deleted' WHEN m >= version THEN 'skip_old' WHEN b THEN 'skip_failed' WHEN o THEN 'mark_failed'
                     WHEN a > version AND a_log = 0 THEN 'import_keep_aux' WHEN a > version THEN 'import_aux' ELSE 'import' END AS action FROM k)
       SELECT 'direct' AS mode, log_id, block_id, version, 'ignore' AS action, NULL::BIGINT AS import_version FROM e
       UNION ALL SELECT 'dirty', log_id, block_id, version, CASE WHEN a_log >= log_id THEN 'error' WHEN m >= version THEN 'skip_old' WHEN b THEN 'skip_failed' ELSE 'volatile' END, NULL FROM k
       UNION ALL SELECT 'background', log_id, block_id, version, action, CASE WHEN action = 'import_aux' THEN a WHEN action LIKE 'import%' THEN version END FROM bg""")
def block_replay(spark, d):
    """Every order is a written event of its customer's block, replayed in each mode against two tiers, failed versions and open containers."""
    e = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("log_id"), F.col("o_custkey").alias("block_id"), (F.col("o_orderkey") % 7 + 1).alias("version"))
    k = e.select("block_id").distinct()
    main = k.where("block_id % 3 <> 0").withColumn("version", F.col("block_id") % 5)
    aux = k.where("block_id % 4 <> 0").select("block_id", (F.col("block_id") % 6).alias("version"), F.when(F.col("block_id") % 5 == 0, 0).otherwise(F.col("block_id") * 8).alias("event_log_id"))
    failed, uncommitted = e.where("log_id % 11 = 0"), e.where("log_id % 13 = 0")
    out = None
    for mode in (blocks.DIRECT, blocks.DIRTY, blocks.BACKGROUND):
        rows = blocks.replay_written(e, main, aux, failed, uncommitted, mode).select(F.lit(mode).alias("mode"), "log_id", "block_id", "version", "action", "import_version")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(X + "SELECT write_seq, chunk_no, block_id, item_start, item_size, CASE WHEN chunk_no % 3 <> 0 THEN fp END AS fp, CASE WHEN chunk_no % 3 <> 0 THEN chunk_no % 3 END AS data_address FROM items")
def mapping_merge_pending(spark, d):
    """Pending items get the name and address of their chunk; those whose chunk is not stored yet stay without."""
    pending = _items(spark, d).drop("fp", "chunk_offset")
    stored = _chunks(spark, d).where("chunk_no % 3 <> 0").select("write_seq", "chunk_no", "fp", (F.col("chunk_no") % 3).alias("data_address"))
    return blocks.pending_merge(pending, stored)


@query(_TIERS + """, p AS (SELECT block_id, fp, data_address FROM prev WHERE block_id % 2 = 0), s AS (SELECT block_id, fp, data_address, -1 AS s FROM p UNION ALL SELECT block_id, fp, data_address + 100, 1 FROM upd)
       SELECT block_id, fp, sum(s)::BIGINT AS delta, max(data_address) AS data_address FROM s WHERE fp <> '02' GROUP BY 1, 2 HAVING sum(s) <> 0""")
def mapping_diff_address(spark, d):
    """Changes of the counts with the address: the new version's, which lies 100 further on, where it has the chunk."""
    old, new = _tiers(spark, d)
    return mapping.usage_diff(old.where("block_id % 2 = 0"), new.withColumn("data_address", F.col("data_address") + 100))


@query(""", nw AS (SELECT write_seq // 2 AS block_id, chunk_no AS pos, fp, size FROM chunks WHERE write_seq % 2 = 1) SELECT block_id, 2 AS version, 77 AS event_log_id, pos, fp, size FROM nw""")
def mapping_rebuild(spark, d):
    """The mapping that was written, from its pair of old and new."""
    version = lambda c: c.select(F.floor(F.col("write_seq") / 2).alias("block_id"), F.col("chunk_no").alias("pos"), "fp", "size")
    c = _chunks(spark, d)
    pair = mapping.pair_diff(version(c.where("write_seq % 2 = 0")), version(c.where("write_seq % 2 = 1")))
    return blocks.rebuild_modified(pair.withColumn("version", F.lit(2)), 77)


# Log


@query(X + """, p AS (SELECT log_id AS seq, CASE event_type WHEN 'purchase' THEN 'block_mapping_written' WHEN 'signup' THEN 'container_committed' WHEN 'error' THEN 'block_mapping_write_failed' ELSE event_type END AS event_type FROM logt)
       SELECT seq, event_type, CASE WHEN event_type IN ('block_mapping_written', 'container_committed', 'block_mapping_write_failed') THEN 500 + row_number() OVER (PARTITION BY event_type IN ('block_mapping_written', 'container_committed', 'block_mapping_write_failed') ORDER BY seq) END AS log_id FROM p""")
def log_commit(spark, d):
    """Events of persistent types are numbered on from 500; the others are only published."""
    return events.commit(_typed(spark, d), 500, "seq")


def _typed(spark, d):
    kind = F.col("event_type")
    named = F.when(kind == "purchase", "block_mapping_written").when(kind == "signup", "container_committed").when(kind == "error", "block_mapping_write_failed").otherwise(kind)
    return tables.log(spark, d).select(F.col("log_id").alias("seq"), named.alias("event_type"))


@query(X + """, n AS (SELECT log_id, event_type, event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY log_id) AS new FROM logt WHERE log_id >= 7),
       r AS (SELECT log_id, event_type, max(CASE WHEN new THEN log_id END) OVER (ORDER BY log_id) AS run FROM n) SELECT log_id, event_type, log_id - (log_id - run) % 2 AS batch FROM r""")
def log_replay_batches(spark, d):
    """What a background replay from id 7 on takes together: events of one type in a row, two at most."""
    return events.runs(tables.log(spark, d).select("log_id", "event_type"), 2, 7)


def _event_log(spark, d, name):
    e = tables.log(spark, d).select(F.col("log_id").alias("seq"), "event_type", "fp", "delta")
    log = EventLog(spark, folder(spark, name), "log_id long, event_type string, seq long, fp long, delta long")
    stored = F.col("event_type") != "view"
    return log, e, stored


@query(X + """, s AS (SELECT *, row_number() OVER (ORDER BY log_id) AS id FROM logt WHERE event_type <> 'view')
       SELECT c.consumer, event_type, count(*) AS events, sum(delta)::BIGINT AS delta, max(id) AS last_id FROM s, (VALUES ('counts'), ('flaky')) c(consumer) GROUP BY 1, 2""")
def log_background_replay(spark, d):
    """Events arrive in two commits, and are replayed after each by two consumers. One of them fails the first time: it loses nothing and holds up no one."""
    log, e, stored = _event_log(spark, d, "background")
    count = lambda rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("delta").alias("delta"), F.max("log_id").alias("last_id"))
    failures = [True]

    def flaky(rows):
        if failures.pop() if failures else False:
            raise RuntimeError("not now")
        return count(rows)

    for part in (0, 1):
        log.commit(e.where(F.pmod(F.floor(F.col("seq") / 4096), F.lit(2)) == part) if part is None else e.where("seq < 600" if part == 0 else "seq >= 600"), "seq", stored)
        log.background({"counts": count, "flaky": flaky}, 64)
    out = None
    for name in ("counts", "flaky"):
        rows = log.results(name).groupBy("event_type").agg(F.sum("events").alias("events"), F.sum("delta").alias("delta"), F.max("last_id").alias("last_id")).select(F.lit(name).alias("consumer"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(X + """, s AS (SELECT *, row_number() OVER (ORDER BY log_id) AS id FROM logt WHERE event_type <> 'view'), p AS (SELECT count(*) + 1 AS position FROM s WHERE log_id < 600)
       SELECT event_type, count(*) AS events, min(id) AS first_id, (SELECT position FROM p) AS position FROM s WHERE log_id >= 600 GROUP BY 1""")
def log_dirty_replay(spark, d):
    """After a crash the open range is replayed, and the position stays where it was."""
    log, e, stored = _event_log(spark, d, "dirty")
    count = lambda rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.min("log_id").alias("first_id"))
    log.commit(e.where("seq < 600"), "seq", stored)
    log.background({"counts": count})
    log.commit(e.where("seq >= 600"), "seq", stored)
    seen = kept(log.dirty("counts", count), "dirty-seen")
    return seen.withColumn("position", F.lit(log.position("counts")).cast("long"))


@query(X + ", s AS (SELECT count(*) AS n FROM logt WHERE event_type <> 'view') SELECT n + 1 AS log_id, 'log_empty' AS event_type, n + 2 AS position, false AS again FROM s")
def log_empty_event(spark, d):
    """Once the replay has caught up, one event says so; a second replay with nothing to do adds none."""
    log, e, stored = _event_log(spark, d, "empty")
    log.commit(e, "seq", stored)
    log.background({"all": lambda rows: rows.select("log_id")})
    log.note_empty("all")
    again = log.note_empty("all")
    last = log.read().where(F.col("event_type") == events.LOG_EMPTY).select("log_id", "event_type")
    return last.select("*", F.lit(log.position("all")).cast("long").alias("position"), F.lit(again).alias("again"))


@query(""", s AS (SELECT log_id // 1000 AS step, max(log_id) + 1 AS log_id, min(log_id) // 2 AS replay_id FROM logt GROUP BY 1), h AS (SELECT *, log_id - replay_id AS held FROM s)
       SELECT step, 8000 - held AS free, round(held / 8000, 6) AS fill, held + 500 >= 8000 - 1000 AS nearly_full, 8000 - held < 8000 * 0.5 AS soft_full, 8000 - held < 8000 * 0.25 AS hard_full FROM h""")
def log_fullness(spark, d):
    """How full a log of 8,000 places is after every thousand events, with half of them replayed."""
    s = tables.log(spark, d).groupBy(F.floor(F.col("log_id") / 1000).alias("step")).agg((F.max("log_id") + 1).alias("log_id"), F.floor(F.min("log_id") / 2).alias("replay_id"))
    state = events.fullness(F.col("log_id"), F.col("replay_id"), 8000, 500, 1000)
    return s.select("step", *[c.alias(n) for n, c in state.items()])


# Collection


@query(X + """, i AS (SELECT fp, 10 AS usage_count, (fp % 10) * 1000 AS seen FROM (SELECT DISTINCT fp FROM logt) WHERE fp % 3 <> 0), f AS (SELECT fp, sum(delta) AS dl, max(log_id) AS l, arg_max(block_id, log_id) AS h FROM logt JOIN i USING (fp) WHERE delta <> 0 AND log_id > seen GROUP BY fp)
       SELECT fp, 10 + coalesce(dl, 0)::BIGINT AS usage_count, coalesce(l, seen) AS change_log_id, coalesce(h, -1) AS block_hint FROM i LEFT JOIN f USING (fp)""")
def gc_direct_replay(spark, d):
    """Events are applied where the index row's change id is lower; the index lacks every third fingerprint."""
    after, _ = _direct(spark, d)
    return after


def _direct(spark, d):
    log = tables.log(spark, d)
    ids = log.select("fp").distinct().where("fp % 3 <> 0")
    index = ids.select("fp", F.lit(10).cast("long").alias("usage_count"), (F.col("fp") % 10 * 1000).alias("change_log_id"), F.lit(-1).cast("long").alias("block_hint"))
    return storage.direct_replay(index, log)


@query(X + "SELECT log_id, fp FROM logt WHERE delta <> 0 AND fp % 3 <> 0 AND log_id <= (fp % 10) * 1000")
def gc_replayed_before(spark, d):
    """Events that the rows' change ids show to be applied already."""
    return _direct(spark, d)[1]


@query(X + """, c AS (SELECT fp, sum(delta)::BIGINT - 12 AS n, max(log_id) - CASE WHEN fp % 2 = 0 THEN 0 ELSE 300 END AS seen, CASE WHEN fp % 5 = 0 THEN max(log_id) + 1 END AS failed FROM logt GROUP BY fp)
       SELECT log_id, fp FROM logt JOIN c USING (fp) WHERE n <= 0 AND greatest(seen, coalesce(failed, 0)) <= log_id""")
def gc_background_candidates(spark, d):
    """Events after which an unused chunk becomes a candidate: those that no later change will find it by."""
    log = tables.log(spark, d)
    seen = F.max("log_id") - F.when(F.col("fp") % 2 == 0, 0).otherwise(300)
    index = log.groupBy("fp").agg((F.sum("delta") - 12).alias("usage_count"), seen.alias("change_log_id"), F.when(F.col("fp") % 5 == 0, F.max("log_id") + 1).alias("failed_log_id"))
    return storage.background_candidates(index, log.select("log_id", "fp"))


@query(X + """, c AS (SELECT fp FROM logt GROUP BY fp HAVING sum(delta) <= 5) SELECT DISTINCT fp % 4 AS container_id, fp, fp IN (SELECT fp FROM c) AND fp % 4 = fp % 8 AS candidate FROM logt""")
def gc_is_candidate(spark, d):
    """Whether each fingerprint is a candidate of the container asked for; half of the candidates are listed under another one."""
    log = tables.log(spark, d)
    listed = log.groupBy("fp").agg(F.sum("delta").alias("n")).where("n <= 5").select((F.col("fp") % 8).alias("container_id"), "fp")
    return storage.is_candidate(log.select((F.col("fp") % 4).alias("container_id"), "fp").distinct(), listed)


# Volumes

_VOLUMES = "VALUES (1, 400 * 16777216::BIGINT, false), (2, 100 * 16777216::BIGINT, true)"


def _volumes(spark):
    return spark.createDataFrame([(1, 400 << 24, False), (2, 100 << 24, True)], "volume_id int, logical_size long, maintenance boolean")


def _requests(spark, d):
    both = tables.writes(spark, d).unionByName(tables.page_writes(spark, d)).select("write_seq", "volume_id", "offset", "size")
    return both.withColumn("volume_id", F.when(F.col("write_seq") % 50 == 49, 3).otherwise(F.col("volume_id")))


_REQUESTS = """, pg AS (SELECT page_id AS write_seq, 2 AS v, page_id * 16777216 + 1000 AS off, octet_length(encode(coalesce(html, '')))::BIGINT AS total FROM pages),
q AS (SELECT write_seq, CASE WHEN write_seq % 50 = 49 THEN 3 ELSE v END AS volume_id, off, total FROM (SELECT write_seq, 1 AS v, off, total FROM w UNION ALL SELECT * FROM pg)) """


@query(_REQUESTS + f""" SELECT write_seq, q.volume_id, off AS "offset", total AS size, CASE WHEN n IS NULL THEN 'no_volume' WHEN m THEN 'not_ready' WHEN off + total > n THEN 'out_of_range' ELSE 'ok' END AS state
       FROM q LEFT JOIN ({_VOLUMES}) v(volume_id, n, m) ON v.volume_id = q.volume_id""")
def volume_requests(spark, d):
    """Which requests their volume takes: one is too small for some, one is in maintenance, one does not exist."""
    return volumes.check_requests(_requests(spark, d), _volumes(spark))


@query(_REQUESTS + """ SELECT volume_id, state, count(*) AS requests FROM (SELECT q.volume_id, CASE WHEN q.volume_id = 3 THEN 'no_volume' WHEN q.volume_id = 2 THEN 'not_ready' WHEN off + total > 150 * 16777216::BIGINT THEN 'out_of_range' ELSE 'ok' END AS state FROM q) GROUP BY ALL""")
def volume_resize(spark, d):
    """Requests by outcome once the first volume has shrunk."""
    smaller = volumes.resize(_volumes(spark), spark.createDataFrame([(1, 150 << 24)], "volume_id int, logical_size long"))
    return volumes.check_requests(_requests(spark, d), smaller).groupBy("volume_id", "state").agg(F.count(F.lit(1)).alias("requests"))


def _page_items(spark, d):
    return mapping.block_items(chunking.static_chunks(tables.page_writes(spark, d), CHUNK), BLOCK)


_PAGE_ITEMS = """, pw AS (SELECT page_id AS write_seq, page_id * 16777216 + 1000 AS off, hex(encode(coalesce(html, ''))) AS hx, octet_length(encode(coalesce(html, '')))::BIGINT AS total FROM pages),
p0 AS (SELECT *, unnest(range(0, (off + total - 1) // 512 - off // 512 + 1)) AS chunk_no FROM pw WHERE total > 0),
p1 AS (SELECT *, greatest(0, (off // 512 + chunk_no) * 512 - off) AS start, least(total, (off // 512 + chunk_no + 1) * 512 - off) AS stop FROM p0),
p2 AS (SELECT *, sha1(unhex(substr(hx, (2 * start + 1)::BIGINT, (2 * (stop - start))::BIGINT))) AS fp FROM p1),
both_items AS (SELECT block_id, fp FROM items UNION ALL SELECT ((2::BIGINT << 47) | ((off + start) // 4096)) AS block_id, fp FROM p2) """  # 512 divides 4096: a page's chunk lies in one block


@query(_PAGE_ITEMS + f""", v AS (SELECT volume_id, n FROM ({_VOLUMES}) v(volume_id, n, m)) SELECT volume_id, count(*) AS items, count(DISTINCT block_id) AS blocks FROM both_items JOIN v ON block_id >= (volume_id::BIGINT << 47) AND block_id < (volume_id::BIGINT << 47) + n // 4096 GROUP BY volume_id""")
def volume_blocks(spark, d):
    """Items and blocks inside each volume's interval of block ids."""
    both = _items(spark, d).unionByName(_page_items(spark, d))
    own = volumes.blocks_of(_volumes(spark), both.select("block_id", "fp"), BLOCK)
    return own.groupBy("volume_id").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("block_id").alias("blocks"))


@query(_PAGE_ITEMS + """, g AS (SELECT block_id, fp FROM both_items WHERE block_id >> 47 = 2), e AS (SELECT block_id, 300 + row_number() OVER (ORDER BY block_id) AS log_id FROM (SELECT DISTINCT block_id FROM g))
       SELECT log_id, fp, -count(*) AS delta FROM g JOIN e USING (block_id) GROUP BY 1, 2""")
def volume_detach_events(spark, d):
    """Detaching the pages' volume: each of its blocks is deleted by an event, which gives back the uses of its chunks."""
    both = _items(spark, d).unionByName(_page_items(spark, d)).select("block_id", "fp")
    return volumes.detach(spark.createDataFrame([(2,)], "volume_id int"), both, 300)[2]


@query(_PAGE_ITEMS + "SELECT block_id, count(*) AS items FROM both_items WHERE block_id >> 47 = 1 GROUP BY 1")
def volume_detach_rest(spark, d):
    both = _items(spark, d).unionByName(_page_items(spark, d)).select("block_id", "fp")
    return volumes.detach(spark.createDataFrame([(2,)], "volume_id int"), both, 300)[0].groupBy("block_id").agg(F.count(F.lit(1)).alias("items"))


_COPY = (1, 3, 150 * (1 << 24) + 5000, 40 * (1 << 24) + 1300)


def _copied(spark, d):
    return volumes.copy_volume(spark.createDataFrame([_COPY], "src int, dst int, size long, done long"), _items(spark, d), BLOCK)


@query(X + f""", i AS (SELECT block_id & ((1::BIGINT << 47) - 1) AS b, fp, item_start, chunk_offset, item_size FROM items), a AS (SELECT *, b * 4096 + item_start AS lo, b * 4096 + item_start + item_size AS hi FROM i),
       k AS (SELECT *, greatest(lo, {_COPY[3]}) AS f, least(hi, {_COPY[2]}) AS t FROM a WHERE lo < {_COPY[2]} AND hi > {_COPY[3]}) SELECT ((3::BIGINT << 47) | b) AS block_id, fp, f - b * 4096 AS item_start, chunk_offset + f - lo AS chunk_offset, t - f AS item_size FROM k""")
def volume_copy(spark, d):
    """A volume's mappings copied to another one, by a job that goes on from where it stopped."""
    return _copied(spark, d)[1]


@query(f"""SELECT i AS step, {_COPY[3]} + i * 67108864 AS "offset", least(67108864, {_COPY[2]} - {_COPY[3]} - i * 67108864) AS size FROM range(0, ({_COPY[2] - _COPY[3]} + 67108863) // 67108864) r(i)""")
def volume_copy_steps(spark, d):
    return _copied(spark, d)[0].select("step", "offset", "size")


STRIDE, WIDE = 1 << 18, 1 << 16


@query("""WITH w AS (SELECT doc_id AS write_seq, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, '')))::BIGINT AS total FROM documents),
       b AS (SELECT *, unnest(range(0, 262144, 65536)) AS lo FROM w), z AS (SELECT *, greatest(0, least(65536, 1000 - lo)) AS before, greatest(0, least(total, lo + 65536 - 1000) - greatest(0, lo - 1000)) AS n FROM b),
       t AS (SELECT write_seq, lo, repeat('00', before::INT) || substr(hx, (2 * greatest(0, lo - 1000) + 1)::BIGINT, (2 * n)::BIGINT) AS h FROM z)
       SELECT 1 AS volume_id, write_seq * 262144 + lo AS "offset", 65536 AS size, sha1(unhex(rpad(h, 131072, '0'))) AS digest FROM t""")
def volume_dump(spark, d):
    """A whole volume dumped block by block, written or not; requests lie 256 KiB apart."""
    w = tables.writes(spark, d).withColumn("offset", F.col("write_seq") * STRIDE + 1000)
    c = chunking.static_chunks(w, WIDE)
    size = w.agg(F.lit(1).alias("volume_id"), ((F.max("write_seq") + 1) * STRIDE).alias("logical_size"))
    out = volumes.dump(size, mapping.block_items(c, WIDE), _stored(c), WIDE)
    return out.select("volume_id", "offset", "size", F.sha1(F.unhex("data")).alias("digest"))


@query(_REQUESTS + """, s AS (SELECT write_seq, off, total FROM q WHERE volume_id = 1 AND off + total <= 400 * 16777216::BIGINT)
       SELECT 'taken' AS what, count(*) AS rows FROM chunks WHERE write_seq IN (SELECT write_seq FROM s) UNION ALL SELECT 'refused', count(*) FROM q WHERE NOT (volume_id = 1 AND off + total <= 400 * 16777216::BIGINT)""")
def stream_ingest_checked(spark, d):
    """Writes that arrive as a stream are checked against their volumes: what is out of range, or for a volume that takes nothing, is refused and leaves no item."""
    both = tables.writes(spark, d).unionByName(tables.page_writes(spark, d))
    both = both.withColumn("volume_id", F.when(F.col("write_seq") % 50 == 49, 3).otherwise(F.col("volume_id")))
    where = folder(spark, "checked")
    _, items = ingest.ingest(ingest.staged(both, where, "write_seq"), where, CHUNK, BLOCK, _volumes(spark))
    taken = items.select("write_seq", "chunk_no").distinct()
    refused = spark.read.parquet(f"{where}/refused")
    count = lambda rows, what: rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(what).alias("what"), "rows")
    return count(taken, "taken").unionByName(count(refused, "refused"))


# Containers


def _container_rows(spark, d):
    stored = _packed(spark, d).select("fp", "container_id").join(_stored(_chunks(spark, d)), "fp")
    return stored.select("container_id", F.col("container_id").alias("original_id"), "fp", "chunk", (F.col("fp") < "2").alias("deleted"))


@query(X + """SELECT container_id, container_id AS original_id, fp, size AS raw_size, fp < '2' AS deleted, (sum(size) OVER (PARTITION BY container_id ORDER BY fp) - size)::BIGINT AS item_offset, size AS item_size FROM packed""")
def container_metadata(spark, d):
    """Containers are written to files and their items listed again, without a byte of their payload."""
    path = folder(spark, "containers")
    containers.write_containers(_container_rows(spark, d), path)
    return containers.container_items(spark, path)


@query(X + "SELECT container_id, count(*) AS items, container_id % 5 <> 0 AS ok, count(*) FILTER (container_id % 5 <> 0) AS sound FROM packed GROUP BY container_id")
def container_load_verified(spark, d):
    """Stored containers are loaded with their checksum; every fifth one was damaged, and gives no bytes."""
    path, worse = folder(spark, "containers"), folder(spark, "damaged")
    containers.write_containers(_container_rows(spark, d), path)
    files = spark.read.parquet(path)
    damaged = F.when(F.col("container_id") % 5 == 0, F.overlay("payload", F.encode(F.lit("~~~~~"), "UTF-8"), F.lit(1))).otherwise(F.col("payload"))
    files.withColumn("payload", damaged).write.partitionBy("part").parquet(worse)
    items = containers.load_items(spark, worse)
    return items.groupBy("container_id").agg(F.count(F.lit(1)).alias("items"), F.bool_and("ok").alias("ok"), F.count(F.when(F.sha1("chunk") == F.col("fp"), 1)).alias("sound"))


_REWRITE = """, t AS (SELECT *, fp < '2' AS was, fp < '6' AND container_id % 3 = 0 AS gone FROM packed), hit AS (SELECT DISTINCT container_id FROM t WHERE gone AND NOT was) """


def _rewritten(spark, d):
    items = _packed(spark, d).select("container_id", F.col("container_id").alias("original_id"), "fp", F.col("size").alias("raw_size"), (F.col("fp") < "2").alias("deleted"))
    return containers.rewrite_deleted(items, items.where("fp < '6' and container_id % 3 = 0").select("container_id", "fp"), 2)


@query(_REWRITE + "SELECT container_id, container_id AS original_id, fp, size AS raw_size, was OR gone AS deleted FROM t WHERE container_id IN (SELECT container_id FROM hit)")
def container_rewrite(spark, d):
    """Containers of which live items are deleted, as they are written anew."""
    return _rewritten(spark, d)[0].select("container_id", "original_id", "fp", "raw_size", "deleted")


@query(_REWRITE + "SELECT container_id, 2 AS generation, count(*) FILTER (NOT (was OR gone)) AS active_items, coalesce(sum(size) FILTER (NOT (was OR gone)), 0)::BIGINT AS active_bytes FROM t WHERE container_id IN (SELECT container_id FROM hit) GROUP BY 1")
def container_move_events(spark, d):
    return _rewritten(spark, d)[1]


_MERGED = """, t AS (SELECT container_id, container_id + CASE WHEN fp < '3' THEN 1000 ELSE 0 END AS original_id, fp, size, fp >= '4' OR container_id % 4 = 3 AS deleted, container_id // 4 AS g FROM packed),
p AS (SELECT g, min(original_id) AS primary_id FROM t WHERE NOT deleted GROUP BY g) """


def _merge(spark, d):
    original = F.col("container_id") + F.when(F.col("fp") < "3", 1000).otherwise(0)
    items = _packed(spark, d).select("container_id", original.alias("original_id"), "fp", F.col("size").alias("raw_size"), ((F.col("fp") >= "4") | (F.col("container_id") % 4 == 3)).alias("deleted"))
    return containers.merged_items(items, items.select("container_id", F.floor(F.col("container_id") / 4).alias("merge_group")).distinct())


@query(_MERGED + "SELECT primary_id AS container_id, original_id, fp, size AS raw_size, false AS deleted FROM t JOIN p USING (g) WHERE NOT deleted")
def container_merge_items(spark, d):
    """The live items of merged containers; some had been moved before and have another original id."""
    return _merge(spark, d)[0]


@query(_MERGED + """, i AS (SELECT g, original_id AS id, bool_or(NOT deleted) AS alive FROM (SELECT g, original_id, deleted FROM t UNION ALL SELECT g, container_id, true FROM t) GROUP BY 1, 2)
       SELECT id AS container_id, CASE WHEN alive THEN primary_id END AS primary_id FROM i LEFT JOIN p USING (g)""")
def container_merge_addresses(spark, d):
    """Where every id of merged containers leads afterwards; null: nowhere any more."""
    return _merge(spark, d)[1]


@query(X + """SELECT fp, container_id + CASE WHEN fp < '1' THEN 1 ELSE 0 END AS address, CASE WHEN fp >= '2' THEN container_id END AS container_id,
       CASE WHEN fp >= '2' THEN (sum(size) OVER (PARTITION BY container_id ORDER BY fp) - size)::BIGINT END AS item_offset, CASE WHEN fp >= '2' THEN false END AS deleted, fp >= '2' AS found FROM packed""")
def container_find(spark, d):
    """Items found by name and address: deleted ones (below 2) are not, nor are those asked for in another container (below 1)."""
    path = folder(spark, "containers")
    containers.write_containers(_container_rows(spark, d), path)
    items = containers.container_items(spark, path)
    asked = items.select("fp", (F.col("container_id") + F.when(F.col("fp") < "1", 1).otherwise(0)).alias("address"))
    return containers.find_items(asked, items)


_COMMITTED = ", s AS (SELECT lane, container_id, count(*) AS items, sum(size)::BIGINT AS bytes FROM packed GROUP BY 1, 2), c AS (SELECT *, max(container_id) OVER (PARTITION BY lane) AS newest FROM s) "


@query(_COMMITTED + "SELECT 100 + row_number() OVER (ORDER BY container_id) AS log_id, container_id, items, bytes, round(bytes / 65536, 6) AS fill, 'container_committed' AS event_type FROM c WHERE container_id < newest AND container_id % 6 <> 0")
def container_commit(spark, d):
    """Commit events of the containers that are full; every sixth one was committed before."""
    packed = kept(_packed(spark, d), "commit")
    return containers.commit_open(packed, packed.where("container_id % 6 = 0").select("container_id").distinct(), CONTAINER, 100)


@query(_COMMITTED + "SELECT row_number() OVER (ORDER BY container_id) AS log_id, container_id, items, bytes, round(bytes / 65536, 6) AS fill, 'container_committed' AS event_type FROM c WHERE container_id = newest")
def container_flush(spark, d):
    """A flush commits what is still open."""
    packed = kept(_packed(spark, d), "flush")
    done = containers.commit_open(packed, packed.limit(0), CONTAINER, 0).select("container_id")
    return containers.commit_open(packed, done, CONTAINER, 0, force=True)


@query(X + """, st AS (SELECT container_id, count(*) FILTER (fp >= 'a') AS active_items, coalesce(sum(size) FILTER (fp >= 'a'), 0)::BIGINT AS active_bytes FROM packed GROUP BY 1)
       SELECT container_id, active_bytes, active_items, active_bytes // 4096 AS bucket FROM st WHERE active_bytes <= 0.4 * 65536 AND active_items <= 0.4 * 1511 AND container_id % 3 <> 0""")
def merge_candidates_untouched(spark, d):
    """Candidates for merging but for the ones that were changed a moment ago."""
    state = _state(spark, d)
    return storage.merge_candidates(state, CONTAINER, touched=state.where("container_id % 3 = 0"))


@query(X + """, a AS (SELECT container_id, CASE WHEN container_id % 4 = 1 THEN container_id - 1 WHEN container_id % 16 = 6 THEN container_id - 1 WHEN container_id % 16 = 10 THEN 100000 END AS primary_id, container_id % 2 AS file_id, container_id // 6 AS file_offset FROM (SELECT DISTINCT container_id FROM packed)),
       m AS (SELECT a.container_id, a.primary_id, b.container_id AS t, b.primary_id AS p FROM a LEFT JOIN a b ON a.primary_id = b.container_id WHERE a.primary_id IS NOT NULL)
       SELECT CASE WHEN t IS NULL THEN 'redirect_lost' ELSE 'redirect_chain' END AS kind, container_id AS key, primary_id AS detail FROM m WHERE t IS NULL OR p IS NOT NULL
       UNION ALL SELECT 'same_place', min(container_id), count(*) FROM a WHERE primary_id IS NULL GROUP BY file_id, file_offset HAVING count(*) > 1
       UNION ALL SELECT 'redirect_unused', container_id, primary_id FROM a WHERE primary_id IS NOT NULL AND container_id % 8 <> 1""")
def check_redirects(spark, d):
    """Faults of the address table: chains, lost targets, shared places, redirects that nothing uses."""
    ids = _packed(spark, d).select("container_id").distinct()
    k = F.col("container_id")
    to = F.when(k % 4 == 1, k - 1).when(k % 16 == 6, k - 1).when(k % 16 == 10, 100000)
    a = ids.select("container_id", to.cast("long").alias("primary_id"), (k % 2).alias("file_id"), F.floor(k / 6).alias("file_offset"))
    items = a.where("primary_id is not null and container_id % 8 = 1").select(F.col("primary_id").alias("container_id"), F.col("container_id").alias("original_id"))
    return storage.redirect_violations(a, items)


# Metrics and control


@query("SELECT event_type AS step, count(*) AS calls, round(sum(value) / 1000, 6) AS seconds FROM events GROUP BY 1")
def profile_totals(spark, d):
    return metrics.profile(tables.read(spark, d, "events").select(F.col("event_type").alias("step"), (F.col("value") / 1000).alias("s")), "step", "s")


@query("SELECT event_type AS opcode, count(*) AS commands, count(*) FILTER (value > 90) AS errors FROM events GROUP BY 1")
def opcode_counters(spark, d):
    return metrics.opcode_counters(tables.read(spark, d, "events").withColumnRenamed("event_type", "opcode"), F.col("value") > 90)


@query("""WITH n AS (SELECT max(epoch_us(ts)) - 3600000000 AS now FROM events), s AS (SELECT user_id, value, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE epoch_us(ts) < (SELECT now FROM n)),
       h AS (SELECT user_id, value, least(coalesce(nxt, now), now) - greatest(t, now - 864000 * 1000000::BIGINT) AS dt FROM s, n) SELECT user_id, round(sum(value * dt) / sum(dt), 6) AS average FROM h WHERE dt > 0 GROUP BY user_id""")
def timed_average_window(spark, d):
    """Time-weighted averages over the ten days before an hour before the last event."""
    e = tables.read(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    now = e.agg((F.max("t") - 3_600_000_000).alias("now"))  # one row
    return metrics.timed_average(e.join(F.broadcast(now)), "user_id", "t", "value", F.col("now"), 864000)


@query("SELECT event_type AS name, sum(CASE WHEN event_id >= 300 THEN 2 ELSE 1 END)::BIGINT AS value FROM events GROUP BY 1")
def stats_restore(spark, d):
    """Counters are saved, restored after a stop, counted on and saved again; the last saved value holds."""
    path, e = folder(spark, "stats"), tables.read(spark, d, "events")
    count = lambda rows: rows.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    metrics.persist(count(e), "other", path)
    metrics.persist(count(e), "log", path)
    before = kept(metrics.restore(spark, "log", path), "restored")
    after = before.unionByName(count(e.where("event_id >= 300"))).groupBy("name").agg(F.sum("value").alias("value"))
    metrics.persist(after, "log", path)
    return metrics.restore(spark, "log", path)


@query(X + """, c2 AS (SELECT write_seq, off, hx, total, unnest(range(0, (off + total - 1) // 1024 - off // 1024 + 1)) AS chunk_no FROM w WHERE total > 0),
       c3 AS (SELECT *, greatest(0, (off // 1024 + chunk_no) * 1024 - off) AS start, least(total, (off // 1024 + chunk_no + 1) * 1024 - off) AS stop FROM c2),
       c4 AS (SELECT write_seq, sha256(unhex(substr(hx, (2 * start + 1)::BIGINT, (2 * (stop - start))::BIGINT))) AS fp FROM c3), o AS (SELECT DISTINCT fp FROM c4 WHERE write_seq % 2 = 0)
       SELECT CASE WHEN fp IN (SELECT fp FROM o) THEN 3 ELSE 1 END AS decision, count(*) AS chunks FROM c4 WHERE write_seq % 2 = 1 GROUP BY 1""")
def configured_chain(spark, d):
    """A system as its options describe it: chunker, size, fingerprint and filters come from the lines of a configuration."""
    from ..config import load, system

    lines = ["# a small system", "chunking=static", "chunking.size=1K", "fingerprinting=sha256", "filter=sampling-filter  # asked first", "filter=chunk-index-filter", "filter.sampling-strategy=full"]
    chunked, names = system(load(lines))
    c = chunked(tables.writes(spark, d))
    index = dedup.chunk_index(c.where("write_seq % 2 = 0")).select("fp", F.col("first_seq").alias("index_address"))
    return dedup.chain(c.where("write_seq % 2 = 1"), names, index=index, factor=None).groupBy("decision").agg(F.count(F.lit(1)).alias("chunks"))


@query(X + """SELECT 'log 500' AS command, 'event_type' AS field, event_type AS value FROM logt WHERE log_id = 500 UNION ALL SELECT 'log 500', 'fp', fp::VARCHAR FROM logt WHERE log_id = 500
       UNION ALL SELECT 'chunks', 'items', count(*)::VARCHAR FROM idx UNION ALL SELECT 'block ' || ((1::BIGINT << 47) | 4096), fp, item_size::VARCHAR FROM items WHERE block_id = ((1::BIGINT << 47) | 4096)
       UNION ALL SELECT 'gc', 'candidates', count(*)::VARCHAR FROM (SELECT fp FROM logt GROUP BY fp HAVING sum(delta) <= 0) UNION ALL SELECT 'idle force-busy', 'idle', 'false' UNION ALL SELECT 'idle force-idle', 'idle', 'true'""")
def control_commands(spark, d):
    """Commands of the shell, each with what it answers."""
    from ..control import Control

    control = Control({"log": tables.log(spark, d), "items": _items(spark, d), "index": _index(spark, d)})
    return control.run_all(["log 500", "chunks", f"block {(1 << BLOCK_SHIFT) | 4096}", "gc", "idle force-idle", "idle force-busy"])
