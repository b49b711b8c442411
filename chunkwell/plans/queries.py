"""Queries over the driver's tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RabinOptions
from ..functions import hashing_sql, rabin_sql
from ..functions.fingerprints import block_id, fingerprint, is_anchor, zero_rewrite
from ..operators import chunking, containers, dedup, events, mapping, storage
from ..sources import tables
from ..sources.shared import folder, kept

CHUNK, BLOCK, CONTAINER = 512, 4096, 65536
RABIN = RabinOptions(average=512, least=128, most=2048)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (_BASE + sql) if sql.lstrip().startswith(",") else sql
        return f

    return add


#: Requests and static chunks, as ``chunks`` and ``idx`` for the queries below.
_BASE = """
WITH RECURSIVE w AS (SELECT doc_id AS write_seq, source, doc_id * 16777216 + 1000 AS off, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, '')))::BIGINT AS total FROM documents),
c0 AS (SELECT *, unnest(range(0, (off + total - 1) // 512 - off // 512 + 1)) AS chunk_no FROM w WHERE total > 0),
c1 AS (SELECT *, greatest(0, (off // 512 + chunk_no) * 512 - off) AS start, least(total, (off // 512 + chunk_no + 1) * 512 - off) AS stop FROM c0),
chunks AS (SELECT write_seq, source, off, chunk_no, start, stop - start AS size, sha1(unhex(substr(hx, (2 * start + 1)::BIGINT, (2 * (stop - start))::BIGINT))) AS fp, unhex(substr(hx, (2 * start + 1)::BIGINT, (2 * (stop - start))::BIGINT)) AS piece FROM c1),
idx AS (SELECT fp, min(write_seq) AS first_seq, arg_min(chunk_no, write_seq * 1000000 + chunk_no) AS first_no, max(size) AS size, count(*) AS usage_count FROM chunks GROUP BY fp),
items0 AS (SELECT *, unnest(range((off + start) // 4096, (off + start + size - 1) // 4096 + 1)) AS b FROM chunks),
items AS (SELECT write_seq, chunk_no, ((1::BIGINT << 47) | b) AS block_id, fp, greatest(off + start, b * 4096) - b * 4096 AS item_start, greatest(off + start, b * 4096) - (off + start) AS chunk_offset,
          least(off + start + size, (b + 1) * 4096) - greatest(off + start, b * 4096) AS item_size FROM items0),
ranked AS (SELECT fp, size, row_number() OVER (ORDER BY first_seq, first_no) - 1 AS r FROM idx),
laned AS (SELECT fp, size, r, r % 8 AS lane, r // 8 AS pos FROM ranked),
fitted AS (SELECT lane, pos, fp, size, r, size AS used, 1 AS n, 0 AS number FROM laned WHERE pos = 0 UNION ALL
           SELECT q.lane, q.pos, q.fp, q.size, q.r, CASE WHEN closed THEN q.size ELSE used + q.size END, CASE WHEN closed THEN 1 ELSE n + 1 END, CASE WHEN closed THEN number + 1 ELSE number END
           FROM (SELECT f.*, q.fp AS fp2, (f.used + q.size + 84 >= 65536 OR (f.n + 1) * 84 >= 126976) AS closed FROM fitted f JOIN laned q ON q.lane = f.lane AND q.pos = f.pos + 1) f
           JOIN laned q ON q.lane = f.lane AND q.pos = f.pos + 1),
opened AS (SELECT lane, number, min(r) AS r FROM fitted GROUP BY lane, number),
numbered AS (SELECT lane, number, CASE WHEN number = 0 THEN lane + 1 ELSE 8 + row_number() OVER (PARTITION BY number = 0 ORDER BY r) END AS container_id FROM opened),
packed AS (SELECT fp, size, lane, container_id FROM fitted JOIN numbered USING (lane, number)),
logt AS (SELECT event_id AS log_id, event_type, user_id AS fp, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS delta, event_id % 977 AS block_id, ts, value FROM events)
"""


def _chunks(spark, d) -> DataFrame:
    return chunking.static_chunks(tables.writes(spark, d), CHUNK)


def _items(spark, d) -> DataFrame:
    return mapping.block_items(_chunks(spark, d), BLOCK)


def _index(spark, d) -> DataFrame:
    return dedup.chunk_index(_chunks(spark, d))


def _stored(chunks: DataFrame) -> DataFrame:
    """One copy of each chunk: the one at its first place. Bytes are moved for the copies that stay, not for all."""
    first = dedup.chunk_index(chunks.select("fp", "write_seq", "chunk_no", "size")).select("fp", F.col("first_seq").alias("write_seq"), F.col("first_no").alias("chunk_no"))
    return chunks.join(first, ["fp", "write_seq", "chunk_no"], "left_semi").select("fp", "chunk")


def _packed(spark, d) -> DataFrame:
    return containers.pack(_index(spark, d), CONTAINER)


# Chunks and fingerprints


@query(", x AS (SELECT 1) SELECT write_seq, chunk_no, size, fp FROM chunks")
def static_chunks(spark, d):
    return _chunks(spark, d).select("write_seq", "chunk_no", "size", "fp")


@query(", x AS (SELECT 1) SELECT write_seq, chunk_no, md5(piece) AS md5, fp AS sha1, sha256(piece) AS sha256 FROM chunks")
def fingerprints(spark, d):
    c = _chunks(spark, d)
    return c.select("write_seq", "chunk_no", *[fingerprint(F.col("chunk"), k).alias(k) for k in ("md5", "sha1", "sha256")])


@query("," + hashing_sql.sha512("chunks", "write_seq, chunk_no", "hex(piece)", "size") + " SELECT write_seq, chunk_no, sha512 FROM digest")
def fp_sha512(spark, d):
    return _chunks(spark, d).select("write_seq", "chunk_no", fingerprint(F.col("chunk"), "sha512").alias("sha512"))


_CUTS = "," + rabin_sql.cuts("w", RABIN)


@query(_CUTS + " SELECT write_seq, chunk_no, start, fin - start AS size, sha1(unhex(substr(hx, (2 * start + 1)::BIGINT, (2 * (fin - start))::BIGINT))) AS fp, reason FROM cut JOIN w USING (write_seq)")
def rabin_chunks(spark, d):
    return chunking.rabin_chunks(tables.writes(spark, d), RABIN).select("write_seq", "chunk_no", "start", "size", "fp", "reason")


@query(_CUTS + " SELECT reason, count(*) AS chunks, sum(fin - start)::BIGINT AS bytes FROM cut GROUP BY reason")
def rabin_cut_reasons(spark, d):
    return chunking.rabin_chunks(tables.writes(spark, d), RABIN).groupBy("reason").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("bytes"))


@query(""", x AS (SELECT 1) SELECT write_seq, b AS block, greatest(off, b * 4096) - b * 4096 AS block_offset, least(off + total, (b + 1) * 4096) - greatest(off, b * 4096) AS piece_size,
       least(off + total, (b + 1) * 4096) = off + total AS last FROM (SELECT *, unnest(range(off // 4096, (off + total - 1) // 4096 + 1)) AS b FROM w WHERE total > 0)""")
def block_split(spark, d):
    return chunking.split_blocks(tables.writes(spark, d), BLOCK).select("write_seq", "block", "block_offset", "piece_size", "last")


@query(""", z AS (SELECT write_seq, chunk_no, size, CASE WHEN (write_seq + chunk_no) % 5 = 0 THEN unhex(repeat('00', size::INT)) ELSE piece END AS piece FROM chunks)
       SELECT write_seq, chunk_no, CASE WHEN size = 512 AND rtrim(hex(piece), '0') = '' THEN '02' ELSE sha1(piece) END AS fp FROM z""")
def zero_chunk_rewrite(spark, d):
    """Every fifth chunk is zeros, of full size or short: the short ones keep their own digest."""
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("size").cast("int")))
    c = _chunks(spark, d).withColumn("chunk", F.when((F.col("write_seq") + F.col("chunk_no")) % 5 == 0, zeros).otherwise(F.col("chunk")))
    return c.select("write_seq", "chunk_no", zero_rewrite(F.col("chunk"), F.col("size"), fingerprint(F.col("chunk")), CHUNK).alias("fp"))


@query(", x AS (SELECT 1) SELECT size // 64 AS bucket, count(*) AS chunks, sum(size)::BIGINT AS bytes FROM chunks GROUP BY 1")
def chunk_size_histogram(spark, d):
    return _chunks(spark, d).groupBy(F.floor(F.col("size") / 64).alias("bucket")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("bytes"))


# Dedup

_RATIO = "sum(usage_count)::BIGINT AS chunks, count(*) AS distinct_chunks, sum(usage_count * size)::BIGINT AS logical_bytes, sum(size)::BIGINT AS physical_bytes, round(sum(usage_count * size) / sum(size), 6) AS dedup_ratio"


@query(f", x AS (SELECT 1) SELECT {_RATIO} FROM idx")
def dedup_ratio(spark, d):
    return dedup.ratio(_chunks(spark, d))


@query(f", s AS (SELECT source, fp, count(*) AS usage_count, max(size) AS size FROM chunks GROUP BY source, fp) SELECT source, {_RATIO} FROM s GROUP BY source")
def dedup_by_source(spark, d):
    return dedup.ratio(_chunks(spark, d), ["source"])


@query(", x AS (SELECT 1) SELECT fp, first_seq, first_no, size, usage_count FROM idx")
def first_occurrence(spark, d):
    return _index(spark, d)


@query(", x AS (SELECT 1) SELECT write_seq, count(*) AS chunks, sum(CASE WHEN write_seq = first_seq AND chunk_no = first_no THEN 1 ELSE 0 END)::BIGINT AS new_chunks FROM chunks JOIN idx USING (fp) GROUP BY write_seq")
def new_chunks_per_request(spark, d):
    return dedup.with_first(_chunks(spark, d)).groupBy("write_seq").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("is_new").cast("long")).alias("new_chunks"))


@query(", x AS (SELECT 1) SELECT fp, usage_count, size FROM idx WHERE usage_count > 1")
def duplicate_groups(spark, d):
    return _index(spark, d).where("usage_count > 1").select("fp", "usage_count", "size")


@query(", x AS (SELECT 1) SELECT fp FROM idx WHERE ('0x' || substr(fp, 33, 2))::BIGINT & 31 = 31")
def sampling_anchors(spark, d):
    return _index(spark, d).where(is_anchor(F.col("fp"), 32)).select("fp")


def _halves(spark, d):
    c = _chunks(spark, d)
    return c.where("write_seq % 2 = 0"), c.where("write_seq % 2 = 1")


@query(", old AS (SELECT DISTINCT fp FROM chunks WHERE write_seq % 2 = 0) SELECT write_seq, chunk_no, fp IN (SELECT fp FROM old) AS known FROM chunks WHERE write_seq % 2 = 1")
def known_vs_new(spark, d):
    old, new = _halves(spark, d)
    return new.join(old.select("fp", F.lit(True).alias("k")).distinct(), "fp", "left").select("write_seq", "chunk_no", F.coalesce("k", F.lit(False)).alias("known"))


_CHAIN = ("zerochunk-filter", "sampling-filter", "block-index-filter", "chunk-index-filter")


def _decided(spark, d):
    old, new = _halves(spark, d)
    index = dedup.chunk_index(old).select("fp", F.col("first_seq").alias("index_address"))
    previous = new.where("chunk_no % 3 = 0").select((F.col("write_seq") % 64).alias("block_id"), "fp").groupBy("block_id", "fp").agg(F.max("block_id").alias("block_address"))
    probe = new.withColumn("block_id", F.col("write_seq") % 64)
    return dedup.chain(probe, _CHAIN, previous=previous, index=index, factor=2)


_DECIDED = """, old AS (SELECT fp, min(write_seq) AS index_address FROM chunks WHERE write_seq % 2 = 0 GROUP BY fp),
prev AS (SELECT DISTINCT write_seq % 64 AS block_id, fp FROM chunks WHERE write_seq % 2 = 1 AND chunk_no % 3 = 0),
p AS (SELECT c.write_seq, c.chunk_no, c.fp, prev.block_id AS block_address, old.index_address, ('0x' || substr(c.fp, 33, 2))::BIGINT & 1 = 1 AS indexed
      FROM chunks c LEFT JOIN prev ON prev.block_id = c.write_seq % 64 AND prev.fp = c.fp LEFT JOIN old ON old.fp = c.fp WHERE c.write_seq % 2 = 1),
decided AS (SELECT write_seq, chunk_no, fp, CASE WHEN block_address IS NOT NULL THEN 3 WHEN NOT indexed THEN 2 WHEN index_address IS NOT NULL THEN 3 ELSE 1 END AS decision,
            CASE WHEN block_address IS NOT NULL THEN block_address WHEN indexed THEN index_address END AS address FROM p)
"""


@query(_DECIDED + "SELECT write_seq, chunk_no, decision, address, address IS NOT NULL AS known FROM decided")
def filter_chain_decisions(spark, d):
    return _decided(spark, d).select("write_seq", "chunk_no", "decision", "address", "known")


@query(
    _DECIDED
    + """, said AS (SELECT 'sampling-filter' AS filter, 2 AS said FROM p UNION ALL SELECT 'zerochunk-filter', 2 FROM p
       UNION ALL SELECT 'block-index-filter', CASE WHEN block_address IS NOT NULL THEN 3 ELSE 2 END FROM p
       UNION ALL SELECT 'chunk-index-filter', decision FROM decided JOIN p USING (write_seq, chunk_no) WHERE block_address IS NULL)
       SELECT filter, count(*) AS reads, count(*) FILTER (said = 4) AS existing, count(*) FILTER (said = 3) AS strong_hits, count(*) FILTER (said = 2) AS weak_hits,
              count(*) FILTER (said = 1) AS misses, count(*) FILTER (said = 0) AS failures FROM said GROUP BY filter"""
)
def filter_stats(spark, d):
    """What each filter of the chain was asked and said."""
    return dedup.counters(_decided(spark, d), _CHAIN)


_COMPARED = """, old AS (SELECT fp, min(write_seq) AS place FROM chunks WHERE write_seq % 2 = 0 GROUP BY fp),
cmp AS (SELECT c.write_seq, c.chunk_no, c.fp, CASE WHEN old.fp IS NULL THEN 1 WHEN c.fp >= 'e8' THEN 4 WHEN c.fp < '08' OR c.size > 1 AND c.fp < '10' OR c.fp < '18' AND c.fp >= '10' THEN 0 ELSE 4 END AS decision,
               CASE WHEN old.fp IS NULL THEN NULL WHEN c.fp >= 'e8' THEN -2 ELSE old.place END AS found
        FROM chunks c LEFT JOIN old USING (fp) WHERE write_seq % 2 = 1) """


def _compared(spark, d):
    """Of the stored chunks some are gone (below 08), some cut short (below 10), some hold other bytes (below 18); some chunks are at the empty address (from e8 on)."""
    old, new = _halves(spark, d)
    address = F.when(F.col("fp") >= "e8", -2).otherwise(F.col("first_seq")).cast("long")
    index = dedup.chunk_index(old).select("fp", address.alias("index_address"))
    size = F.octet_length("chunk")
    bytes_ = (
        F.when((F.col("fp") < "10") & (size > 1), F.substring("chunk", 1, 1)).when((F.col("fp") < "18") & (F.col("fp") >= "10"), F.encode(F.repeat(F.lit("~"), size), "UTF-8")).otherwise(F.col("chunk"))
    )
    kept_ = old.groupBy("fp").agg(F.min("chunk").alias("chunk")).join(index, "fp").where("fp >= '08'")
    stored = kept_.select("fp", F.col("index_address").alias("stored_address"), bytes_.alias("stored_chunk"))
    return dedup.chain(new, ("chunk-index-filter", "bytecompare-filter"), index=index, stored=stored)


@query(_COMPARED + "SELECT write_seq, chunk_no, decision, CASE WHEN decision > 0 THEN found END AS address, decision = 4 AS known FROM cmp")
def bytecompare_decisions(spark, d):
    """Chunks against an index and a store with faults: what cannot be read back equal is an error, not a new chunk, and has no address."""
    return _compared(spark, d).select("write_seq", "chunk_no", "decision", "address", "known")


@query(_COMPARED + "SELECT fp, count(*) AS chunks FROM cmp WHERE decision = 0 GROUP BY fp")
def chain_errors(spark, d):
    return dedup.errors(_compared(spark, d)).groupBy("fp").agg(F.count(F.lit(1)).alias("chunks"))


@query(_COMPARED + """, n AS (SELECT fp, min(write_seq) AS place FROM cmp WHERE decision = 1 GROUP BY fp)
       SELECT fp, CASE WHEN fp >= 'e8' THEN -2 ELSE place END AS index_address FROM old UNION ALL SELECT fp, place FROM n""")
def chain_update_aborted(spark, d):
    """The update phase behind errors: what was aborted leaves no trace in the index."""
    old, _ = _halves(spark, d)
    index = dedup.chunk_index(old).select("fp", F.when(F.col("fp") >= "e8", -2).otherwise(F.col("first_seq")).cast("long").alias("index_address"))
    return dedup.learn(index, _compared(spark, d))


@query(""", old AS (SELECT fp, min(write_seq) AS place FROM chunks WHERE write_seq % 2 = 0 GROUP BY fp)
       SELECT fp, place AS index_address, coalesce(h, 0) AS block_hint FROM old LEFT JOIN (SELECT fp, arg_max(write_seq % 64, write_seq * 1000000 + chunk_no) AS h FROM chunks WHERE write_seq % 2 = 1 GROUP BY fp) USING (fp)""")
def chain_update_known(spark, d):
    """Known chunks tell the index the block that used them last."""
    old, new = _halves(spark, d)
    index = dedup.chunk_index(old).select("fp", F.col("first_seq").alias("index_address"))
    decided = dedup.chain(new.withColumn("block_id", F.col("write_seq") % 64), ("chunk-index-filter",), index=index)
    return dedup.update_known(index.withColumn("block_hint", F.lit(0).cast("long")), decided)


@query(", old AS (SELECT DISTINCT fp FROM chunks WHERE write_seq % 2 = 0) SELECT write_seq, chunk_no, CASE WHEN fp IN (SELECT fp FROM old) THEN 3 ELSE 0 END AS decision FROM chunks WHERE write_seq % 2 = 1")
def chain_index_full(spark, d):
    """A full index refuses the chunks that it lacks."""
    old, new = _halves(spark, d)
    index = dedup.chunk_index(old).select("fp", F.col("first_seq").alias("index_address"))
    return dedup.chain(new, ("chunk-index-filter",), index=index, accepting=False).select("write_seq", "chunk_no", "decision")


# Keyed tables: the customers as a table, their orders as changes

_CHANGES = "SELECT o_custkey AS k, o_totalprice AS v, o_orderkey AS seq FROM orders"


def _keyed(spark, d):
    table = tables.read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return table, tables.read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))


@query(f"WITH ch AS ({_CHANGES}), l AS (SELECT k, arg_max(v, seq) AS v FROM ch GROUP BY k) SELECT k, v FROM l UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT k FROM l)")
def index_put(spark, d):
    table, changes = _keyed(spark, d)
    return dedup.upsert(table, changes, "k", "seq")


@query(f"WITH ch AS ({_CHANGES}), f AS (SELECT k, arg_min(v, seq) AS v FROM ch GROUP BY k) SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT k, v FROM f WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def index_put_if_absent(spark, d):
    table, changes = _keyed(spark, d)
    return dedup.put_if_absent(table, changes, "k", "seq")


@query(f"WITH ch AS ({_CHANGES}) SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT k FROM ch WHERE seq % 20 = 0)")
def index_delete(spark, d):
    """The customers of every twentieth order go."""
    table, changes = _keyed(spark, d)
    return table.join(changes.where("seq % 20 = 0").select("k"), "k", "left_anti")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS v, c_custkey % 3 = 0 AS swapped FROM customer WHERE c_custkey % 2 = 0")
def index_compare_and_swap(spark, d):
    table, _ = _keyed(spark, d)
    expected = F.when(F.col("k") % 3 == 0, F.col("v")).otherwise(F.col("v") + 1)
    return dedup.compare_and_swap(table, table.select("k", expected.alias("expected"), F.lit(0.0).alias("v")), "k", "v")


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey >= 100 ORDER BY c_custkey LIMIT 20")
def cursor_jump(spark, d):
    return tables.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")).where("k >= 100").orderBy("k").limit(20)


@query("""WITH t AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 7 <> 3), cur AS (SELECT min(k) AS k FROM t WHERE k >= 59)
       SELECT 'first' AS op, k, v FROM t WHERE k = (SELECT min(k) FROM t) UNION ALL SELECT 'last', k, v FROM t WHERE k = (SELECT max(k) FROM t)
       UNION ALL SELECT 'jump', k, v FROM t WHERE k = (SELECT k FROM cur) UNION ALL SELECT 'next', k, v FROM t WHERE k = (SELECT min(k) FROM t WHERE k > (SELECT k FROM cur))
       UNION ALL SELECT 'put', k, -1.0 FROM t WHERE k = (SELECT k FROM cur)
       UNION ALL SELECT 'removed', k, v FROM t WHERE k = (SELECT min(k) FROM t WHERE k > (SELECT k FROM cur))""")
def cursor_ops(spark, d):
    """Where a cursor at 59 (a key that is missing) gets to, the value that it puts there, and what it reaches once the row there is removed."""
    t = tables.read(spark, d, "customer").where("c_custkey % 7 <> 3").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    found = dedup.cursor(t, "k", 59)
    put = dedup.upsert(t, found["jump"].select("k", F.lit(-1.0).alias("v"), F.lit(1).alias("seq")), "k", "seq")
    gone = t.join(F.broadcast(found["jump"].select("k")), "k", "left_anti")  # one row
    ops = found | {"put": dedup.cursor(put, "k", 59)["jump"], "removed": dedup.cursor(gone, "k", 59)["jump"]}
    out = None
    for op, row in ops.items():
        row = row.select(F.lit(op).alias("op"), "k", "v")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH ch AS ({_CHANGES}), l AS (SELECT k, arg_max(v, seq) AS v FROM ch GROUP BY k), pinned AS (SELECT k FROM l WHERE k % 3 = 0),
       m AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0)
       SELECT 'main' AS tier, k, v FROM l WHERE k NOT IN (SELECT k FROM pinned) UNION ALL SELECT 'main', k, v FROM m WHERE k NOT IN (SELECT k FROM l WHERE k NOT IN (SELECT k FROM pinned))
       UNION ALL SELECT 'dirty', k, v FROM l WHERE k IN (SELECT k FROM pinned)""")
def index_persist_dirty(spark, d):
    """Dirty rows are written through, pinned ones stay in their tier."""
    main, changes = _keyed(spark, d)
    aux = dedup.upsert(main.limit(0), changes, "k", "seq")
    after, dirty = dedup.persist_dirty(main, aux, aux.where("k % 3 = 0").select("k"), "k")
    return after.select(F.lit("main").alias("tier"), "k", "v").unionByName(dirty.select(F.lit("dirty").alias("tier"), "k", "v"))


# Mappings


@query(", x AS (SELECT 1) SELECT write_seq, chunk_no, block_id, fp, item_start, chunk_offset, item_size FROM items")
def chunk_to_block_items(spark, d):
    return _items(spark, d)


@query(""", e AS (SELECT block_id, min(item_start) AS lo, max(item_start + item_size) AS hi FROM items GROUP BY block_id),
       f AS (SELECT block_id, fp, item_start, chunk_offset, item_size FROM items UNION ALL SELECT block_id, '02', 0, 0, lo FROM e WHERE lo > 0 UNION ALL SELECT block_id, '02', hi, 0, 4096 - hi FROM e WHERE hi < 4096),
       g AS (SELECT block_id, CASE WHEN fp >= 'fe' THEN 70000 ELSE chunk_offset END AS chunk_offset, CASE WHEN fp < '0180' AND fp >= '01' THEN 0 ELSE item_size END AS item_size FROM f WHERE NOT (fp >= '03' AND fp < '04'))
       SELECT block_id, sum(item_size)::BIGINT AS bytes, count(*) AS items, sum(item_size) = 4096 AND bool_and(item_size > 0 AND item_size <= 65536 AND chunk_offset <= 65536) AS ok FROM g GROUP BY block_id""")
def block_mapping_check(spark, d):
    """Filled blocks with faults: some items are gone, some are empty, some begin too far into their chunk."""
    items = _items(spark, d)
    whole = mapping.fill_empty(items.select("block_id"), items, BLOCK).where("not (fp >= '03' and fp < '04')")
    whole = whole.withColumn("chunk_offset", F.when(F.col("fp") >= "fe", 70000).otherwise(F.col("chunk_offset")))
    return mapping.mapping_check(whole.withColumn("item_size", F.when((F.col("fp") < "0180") & (F.col("fp") >= "01"), 0).otherwise(F.col("item_size"))), BLOCK)


@query(""", r AS (SELECT write_seq, off + 300 AS lo, off + total AS hi, substr(hx, 601) AS h FROM w WHERE total > 300),
       b AS (SELECT *, unnest(range(lo // 4096, (hi - 1) // 4096 + 1)) AS blk FROM r)
       SELECT ((1::BIGINT << 47) | blk) AS block_id, greatest(lo, blk * 4096) - blk * 4096 AS lo, least(hi, (blk + 1) * 4096) - blk * 4096 AS hi,
       lower(substr(h, (2 * (greatest(lo, blk * 4096) - lo) + 1)::BIGINT, (2 * (least(hi, (blk + 1) * 4096) - greatest(lo, blk * 4096)))::BIGINT)) AS data FROM b""")
def read_range(spark, d):
    """Every text of more than 300 bytes from there to its end, through mapping and store."""
    w = tables.writes(spark, d).where("size > 300")
    part = w.select("write_seq", "volume_id", (F.col("offset") + 300).alias("offset"), (F.col("size") - 300).alias("size"))
    ranges = chunking.split_blocks(part, BLOCK).select(block_id(F.col("volume_id"), F.col("block") * BLOCK, BLOCK).alias("block_id"), F.col("block_offset").alias("lo"), (F.col("block_offset") + F.col("piece_size")).alias("hi"))
    c = _chunks(spark, d)
    return mapping.read_range(mapping.block_items(c, BLOCK), _stored(c), ranges)


@query(""", j AS (SELECT DISTINCT block_id AS src, block_id + 1000000 AS dst, 1500 AS lo, 2600 AS hi FROM items)
       SELECT dst AS block_id, fp, greatest(lo, item_start) AS item_start, chunk_offset + greatest(lo, item_start) - item_start AS chunk_offset, least(hi, item_start + item_size) - greatest(lo, item_start) AS item_size
       FROM j JOIN items ON src = block_id AND item_start < hi AND item_start + item_size > lo""")
def fast_copy_remap(spark, d):
    items = _items(spark, d)
    jobs = items.select(F.col("block_id").alias("src")).distinct().select("src", (F.col("src") + 1000000).alias("dst"), F.lit(1500).alias("lo"), F.lit(2600).alias("hi"))
    return mapping.fast_copy(items, jobs)


@query("""WITH o AS (SELECT l_orderkey AS block_id, l_partkey * 10 + l_linenumber AS seq, l_partkey::VARCHAR AS fp, (l_partkey * 37) % 300 AS s, 50 + l_suppkey % 7 * 10 AS n FROM lineitem),
       cell AS (SELECT DISTINCT block_id, unnest(range(s, s + n)) AS pos FROM o),
       top AS (SELECT cell.block_id, pos, arg_max(struct_pack(seq := seq, fp := fp, s := s), seq) AS t FROM cell JOIN o ON o.block_id = cell.block_id AND pos >= s AND pos < s + n GROUP BY cell.block_id, pos),
       g AS (SELECT block_id, pos, t.seq AS seq, t.fp AS fp, t.s AS s, pos - row_number() OVER (PARTITION BY block_id, t.seq ORDER BY pos) AS isl FROM top)
       SELECT block_id, seq, fp, min(pos) AS item_start, min(pos) - min(s) AS chunk_offset, count(*) AS item_size FROM g GROUP BY block_id, seq, fp, isl""")
def overlay_last_writer(spark, d):
    """Every order is a block, its lines are writes to it in order of their parts."""
    o = tables.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("block_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").cast("string").alias("fp"),
        ((F.col("l_partkey") * 37) % 300).alias("item_start"), F.lit(0).cast("long").alias("chunk_offset"), (50 + F.col("l_suppkey") % 7 * 10).alias("item_size"),
    )
    return mapping.overlay(o)


_VERSIONS = """, a AS (SELECT write_seq // 2 AS block_id, fp FROM chunks WHERE write_seq % 2 = 0), b AS (SELECT write_seq // 2 AS block_id, fp FROM chunks WHERE write_seq % 2 = 1),
       s AS (SELECT block_id, fp, -1 AS s FROM a UNION ALL SELECT block_id, fp, 1 FROM b) """


@query(_VERSIONS + "SELECT block_id, fp, sum(s)::BIGINT AS delta FROM s GROUP BY block_id, fp HAVING sum(s) <> 0")
def mapping_diff(spark, d):
    old, new = _halves(spark, d)
    version = lambda c: c.select(F.floor(F.col("write_seq") / 2).alias("block_id"), "fp")
    return mapping.usage_diff(version(old), version(new))


# Counts and collection


@query(", x AS (SELECT 1) SELECT fp, sum(delta)::BIGINT AS usage_count, max(log_id) AS change_log_id, arg_max(block_id, log_id) AS block_hint FROM logt GROUP BY fp")
def usage_counts(spark, d):
    return storage.usage_counts(tables.log(spark, d))


@query(", x AS (SELECT 1) SELECT fp, sum(delta)::BIGINT AS usage_count FROM logt GROUP BY fp HAVING sum(delta) <= 0")
def gc_candidates(spark, d):
    return storage.usage_counts(tables.log(spark, d)).where("usage_count <= 0").select("fp", "usage_count")


@query(""", c AS (SELECT fp, sum(delta)::BIGINT AS usage_count FROM logt GROUP BY fp HAVING sum(delta) <= 0), busy AS (SELECT DISTINCT fp FROM logt WHERE log_id > (SELECT max(log_id) - 40 FROM logt))
       SELECT fp, usage_count, CASE WHEN fp IN (SELECT fp FROM busy) THEN 'keep' WHEN usage_count = 0 THEN 'delete' ELSE 'recheck' END AS action FROM c""")
def gc_after_in_combat(spark, d):
    log = tables.log(spark, d)
    position = log.agg((F.max("log_id") - 40).alias("position"))  # one row
    return storage.collect(storage.usage_counts(log), log.join(F.broadcast(position), F.col("log_id") > F.col("position"), "left_semi"))


@query(""", c AS (SELECT fp, sum(delta)::BIGINT AS n FROM logt GROUP BY fp), u AS (SELECT fp, sum(delta)::BIGINT AS undo FROM logt WHERE event_type = 'signup' GROUP BY fp)
       SELECT fp, n - coalesce(undo, 0) AS usage_count FROM c LEFT JOIN u USING (fp)""")
def failed_write_revert(spark, d):
    log = tables.log(spark, d)
    failed = log.where("event_type = 'signup'").select(F.col("log_id").alias("write_event_log_id"), "fp", "delta")
    return storage.revert_failed(storage.usage_counts(log), failed.unionAll(failed))


@query(", x AS (SELECT 1) SELECT source, fp, -count(*) AS delta FROM items JOIN w USING (write_seq) GROUP BY source, fp")
def volume_detach(spark, d):
    """What detaching each source's volume takes from the counts: one for each item."""
    items = _items(spark, d).join(tables.writes(spark, d).select("write_seq", "source"), "write_seq")
    return items.groupBy("source", "fp").agg((-F.count(F.lit(1))).alias("delta"))


@query(", x AS (SELECT 1) SELECT fp, arg_max(block_id, log_id) AS block_hint FROM logt GROUP BY fp")
def block_hint(spark, d):
    return tables.log(spark, d).groupBy("fp").agg(F.max_by("block_id", "log_id").alias("block_hint"))


# Containers


@query(", x AS (SELECT 1) SELECT container_id, count(*) AS items, sum(size)::BIGINT AS bytes FROM packed GROUP BY container_id")
def container_fill(spark, d):
    return _packed(spark, d).groupBy("container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("bytes"))


@query(", x AS (SELECT 1) SELECT fp, size, lane, container_id FROM packed")
def container_pack_exact(spark, d):
    """Next-fit in eight lanes, which new chunks are dealt to in turn."""
    return _packed(spark, d)


_DELETED = ", st AS (SELECT container_id, sum(CASE WHEN first IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9') THEN 0 ELSE 1 END)::BIGINT AS active_items, sum(CASE WHEN first IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9') THEN 0 ELSE size END)::BIGINT AS active_bytes, count(*) AS all_items FROM (SELECT *, substr(fp, 1, 1) AS first FROM packed) GROUP BY container_id) "


def _state(spark, d):
    packed = _packed(spark, d)
    return storage.delete_items(packed, packed.where("fp < 'a'").select("fp"))


@query(_DELETED + "SELECT * FROM st")
def container_delete(spark, d):
    return _state(spark, d)


@query(_DELETED + "SELECT container_id, active_bytes, active_items, active_bytes // 4096 AS bucket FROM st WHERE active_bytes <= 0.4 * 65536 AND active_items <= 0.4 * 1511")
def merge_candidates_bucketed(spark, d):
    return storage.merge_candidates(_state(spark, d), CONTAINER)


@query(_DELETED.replace(", st AS", ", st0 AS") + """, st AS (SELECT container_id, active_items, CASE WHEN container_id % 9 = 0 THEN 0 ELSE active_bytes END AS active_bytes FROM st0),
       c AS (SELECT container_id, CASE WHEN active_bytes = 0 THEN 0 ELSE active_items END AS active_items, active_bytes FROM st WHERE active_bytes <= 0.7 * 65536 AND active_items <= 0.7 * 1511),
       s AS (SELECT *, row_number() OVER (ORDER BY active_bytes, container_id) AS k FROM c WHERE active_bytes > 0),
       g AS (SELECT 1::BIGINT AS lo, (SELECT count(*) FROM s) AS hi, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS bytes UNION ALL
             SELECT CASE WHEN x.active_bytes + y.active_bytes < 65536 THEN lo + 1 ELSE lo END, hi - 1, CASE WHEN x.active_bytes + y.active_bytes < 65536 THEN x.container_id END,
                    CASE WHEN x.active_bytes + y.active_bytes < 65536 THEN y.container_id END, x.active_bytes + y.active_bytes FROM g JOIN s x ON x.k = lo JOIN s y ON y.k = hi WHERE lo < hi)
       SELECT least(a, b) AS primary_id, greatest(a, b) AS secondary_id, bytes FROM g WHERE a IS NOT NULL UNION ALL SELECT container_id, NULL, 0 FROM c WHERE active_bytes = 0""")
def merge_pairs(spark, d):
    """Greedy pairs of the containers that are at most seven tenths full; those without live bytes are deleted alone."""
    state = _state(spark, d).withColumn("active_bytes", F.when(F.col("container_id") % 9 == 0, 0).otherwise(F.col("active_bytes")))
    state = state.withColumn("active_items", F.when(F.col("active_bytes") == 0, 0).otherwise(F.col("active_items")))
    return storage.merge_pairs(storage.merge_candidates(state, CONTAINER, 0.7), CONTAINER)


@query(", x AS (SELECT 1) SELECT container_id // 4 AS merge_group, min(container_id) AS primary_id, count(DISTINCT container_id) AS containers, count(*) AS live_items FROM packed WHERE fp >= 'a' GROUP BY 1")
def container_merge_ids(spark, d):
    live = _packed(spark, d).where("fp >= 'a'")
    return live.groupBy(F.floor(F.col("container_id") / 4).alias("merge_group")).agg(F.min("container_id").alias("primary_id"), F.countDistinct("container_id").alias("containers"), F.count(F.lit(1)).alias("live_items"))


# Checks


def _planted(spark, d):
    """Block items, an index and stored chunks with faults: index rows that are lost, point elsewhere or miscount, bytes that were changed, unused rows that are no candidates."""
    c = _chunks(spark, d)
    used = mapping.block_items(c, BLOCK).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    base = kept(_packed(spark, d).select("fp", F.col("container_id").alias("address")).join(used, "fp").join(_stored(c), "fp"), "planted")
    first = F.substring("fp", 1, 2)
    items = base.where(first != "44").select("fp", "address", F.explode(F.expr("sequence(1L, n)"))).select("fp", "address")
    count = F.when(first == "44", 0).otherwise(F.col("n") + (first == "22").cast("long"))
    index = base.where(first != "00").select("fp", F.when(first == "11", -1).otherwise(F.col("address")).cast("long").alias("address"), count.cast("long").alias("usage_count"))
    stored = base.select("fp", "address", F.when(first == "33", F.encode(F.lit("x"), "UTF-8")).otherwise(F.col("chunk")).alias("chunk"), F.lit(False).alias("deleted"))
    listed = base.where((first == "44") & (F.col("fp") < "448")).select("fp")
    return items, index, stored, listed


@query(""", u AS (SELECT fp, substr(fp, 1, 2) AS k, container_id AS address, n FROM packed JOIN (SELECT fp, count(*) AS n FROM items GROUP BY fp) USING (fp))
       SELECT 'missing_index' AS kind, fp AS key, n::VARCHAR AS detail FROM u WHERE k = '00' UNION ALL SELECT 'item_not_indexed', fp, address::VARCHAR FROM u WHERE k = '00'
       UNION ALL SELECT 'wrong_address', fp, '-1' FROM u WHERE k = '11' UNION ALL SELECT 'missing_item', fp, '-1' FROM u WHERE k = '11' UNION ALL SELECT 'item_address', fp, '-1' FROM u WHERE k = '11'
       UNION ALL SELECT 'usage_count', fp, '-1' FROM u WHERE k = '22' UNION ALL SELECT 'rehash', fp, sha1('x') FROM u WHERE k = '33' UNION ALL SELECT 'no_candidate', fp, '0' FROM u WHERE k = '44' AND fp >= '448'""")
def check_violations(spark, d):
    """The checker on an index and a store with planted faults."""
    return storage.violations(*_planted(spark, d))


@query(", x AS (SELECT 1) SELECT fp, container_id AS address, n AS usage_count FROM packed JOIN (SELECT fp, count(*) AS n FROM items GROUP BY fp) USING (fp)")
def restore_chunk_index(spark, d):
    return storage.restore_index(_packed(spark, d).withColumn("deleted", F.lit(False)), _items(spark, d))


@query(", c AS (SELECT fp, sum(delta) AS n FROM logt GROUP BY fp) SELECT fp FROM c WHERE n <= 0 AND fp % 5 <> 0")
def check_unlisted_candidates(spark, d):
    zero = storage.usage_counts(tables.log(spark, d)).where("usage_count <= 0")
    listed = zero.where("fp % 5 = 0").select("fp")
    return zero.select("fp").join(listed, "fp", "left_anti")


# Log and metrics


@query(", x AS (SELECT 1) SELECT event_type, count(*) AS events, min(log_id) AS first_id, max(log_id) AS last_id FROM logt GROUP BY event_type")
def log_event_counts(spark, d):
    return tables.log(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.min("log_id").alias("first_id"), F.max("log_id").alias("last_id"))


@query(", x AS (SELECT 1) SELECT log_id, event_type, fp FROM logt ORDER BY log_id DESC LIMIT 50")
def log_last_n(spark, d):
    return tables.log(spark, d).select("log_id", "event_type", "fp").orderBy(F.desc("log_id")).limit(50)


@query(", x AS (SELECT 1) SELECT fp, sum(delta)::BIGINT AS usage_count FROM logt GROUP BY fp")
def replay_usage_counts(spark, d):
    """Replay by Structured Streaming: the log is drained in micro-batches and gives the totals of a batch run."""
    from ..streaming.replay import replay_counts

    where = folder(spark, "replay")
    return replay_counts(spark, tables.log(spark, d).select("log_id", "fp", "delta"), where)


@query(", k AS (SELECT DISTINCT block_id FROM logt WHERE block_id % 101 <> 100), n AS (SELECT block_id, lead(block_id) OVER (ORDER BY block_id) AS nxt FROM k) SELECT min(block_id) AS low_water, (SELECT max(block_id) FROM k) AS highest FROM n WHERE nxt IS NULL OR nxt <> block_id + 1")
def tracker_low_water(spark, d):
    """Last id before the first gap, and the highest id seen: ids whose successor is missing, the least of them."""
    ids = tables.log(spark, d).select("block_id").distinct().where("block_id % 101 <> 100")
    ends = ids.join(ids.select((F.col("block_id") - 1).alias("block_id")), "block_id", "left_anti")
    return ends.agg(F.min("block_id").alias("low_water"), F.max("block_id").alias("highest"))


@query("""WITH s AS (SELECT user_id, (epoch_us(ts) // 1000000)::BIGINT AS sec, value FROM events)
       SELECT user_id, sec, round(sum(value) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) / 86400, 9) AS rate FROM s""")
def sliding_rate(spark, d):
    e = tables.read(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), "value")
    return e.select("user_id", "sec", F.round(F.sum("value").over(Window.partitionBy("user_id").orderBy("sec").rangeBetween(-86399, 0)) / 86400, 9).alias("rate"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS average FROM events")
def sliding_average(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    return tables.read(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("average"))


@query("""WITH s AS (SELECT user_id, value, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
       SELECT user_id, round(sum(value * (nxt - t)) / sum(nxt - t), 6) AS average FROM s WHERE nxt IS NOT NULL GROUP BY user_id""")
def timed_average(spark, d):
    e = tables.read(spark, d, "events").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    held = e.withColumn("dt", F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")) - F.col("t")).where("dt is not null")
    return held.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("dt")) / F.sum("dt"), 6).alias("average"))


@query("""WITH h AS (SELECT epoch_us(ts) // 3600000000 AS hour, avg(value) * 10 AS latency, sum(value) * 60 AS throughput FROM events GROUP BY 1),
       f AS (SELECT hour, coalesce(latency, 0) < 512 AND coalesce(throughput, 0) < 524288 AS calm, hour % 5 = 0 AS forced_idle, hour % 10 = 0 AS forced_busy FROM h)
       SELECT hour, (calm OR forced_idle) AND NOT forced_busy AS idle FROM f""")
def idle_state(spark, d):
    """Idle hours by mean latency and throughput; every fifth hour is forced idle, every tenth forced busy, which wins."""
    e = tables.read(spark, d, "events").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("hour")).agg((F.avg("value") * 10).alias("latency"), (F.sum("value") * 60).alias("throughput"))
    return e.select("hour", events.idle(F.col("latency"), F.col("throughput"), F.col("hour") % 5 == 0, F.col("hour") % 10 == 0).alias("idle"))


@query(""", e AS (SELECT fp AS block_id, log_id, event_type = 'error' AS failed FROM logt),
       r AS (SELECT *, bool_or(failed) OVER (PARTITION BY block_id ORDER BY log_id) AS broken FROM e) SELECT log_id, block_id, NOT broken AS committed FROM r""")
def committed_versions(spark, d):
    """A version of a block commits only if no version before it failed."""
    e = tables.log(spark, d).select("log_id", F.col("fp").alias("block_id"), (F.col("event_type") == "error").alias("failed"))
    first = e.groupBy("block_id").agg(F.min(F.when(F.col("failed"), F.col("log_id"))).alias("broken"))
    return e.join(first, "block_id").select("log_id", "block_id", (F.col("broken").isNull() | (F.col("log_id") < F.col("broken"))).alias("committed"))


@query(", x AS (SELECT 1) SELECT source, count(*) AS requests, sum(total)::BIGINT AS bytes, grouping(source)::BIGINT AS all_volumes FROM w GROUP BY ROLLUP (source)")
def volume_summary(spark, d):
    return tables.writes(spark, d).rollup("source").agg(F.count(F.lit(1)).alias("requests"), F.sum("size").alias("bytes"), F.grouping("source").cast("long").alias("all_volumes"))


@query(", x AS (SELECT 1) SELECT block_id, count(*) AS items, min(item_start) AS first_start, max(item_start + item_size) AS last_end FROM items GROUP BY block_id")
def inspect_blocks(spark, d):
    return _items(spark, d).groupBy("block_id").agg(F.count(F.lit(1)).alias("items"), F.min("item_start").alias("first_start"), F.max(F.col("item_start") + F.col("item_size")).alias("last_end"))


@query(f", r AS (SELECT {_RATIO} FROM idx) SELECT to_json(r)::VARCHAR AS stats FROM r")
def stats_json(spark, d):
    r = dedup.ratio(_chunks(spark, d))
    return r.select(F.to_json(F.struct(*r.columns)).alias("stats"))


# Further container and index states


@query(", x AS (SELECT 1) SELECT DISTINCT container_id AS address, CASE WHEN container_id % 3 = 0 THEN 'committed' WHEN container_id <= 20 THEN 'never' ELSE 'open' END AS state FROM packed")
def container_commit_state(spark, d):
    """Every third container is committed; ids up to 20 were given out before the start."""
    ids = _packed(spark, d).select(F.col("container_id").alias("address")).distinct()
    return storage.commit_state(ids, ids.select(F.col("address").alias("container_id")).where("container_id % 3 = 0"), 20)


@query(", x AS (SELECT 1) SELECT fp, CASE WHEN fp < 'c' AND substr(fp, 2, 1) <> '0' THEN container_id ELSE 0 END AS address FROM packed")
def container_import(spark, d):
    """Committed containers put their live, indexed items that never moved into an index that knew all chunks at address 0."""
    packed = _packed(spark, d)
    original = F.when(F.substring("fp", 2, 1) == "0", F.col("container_id") + 1).otherwise(F.col("container_id"))
    items = packed.select("fp", "container_id", original.alias("original_id"), (F.col("fp") >= "e").alias("deleted"), (F.col("fp") < "c").alias("indexed"))
    return storage.import_containers(packed.select("fp", F.lit(0).cast("long").alias("address")), items)


@query(", x AS (SELECT 1) SELECT fp, container_id AS address FROM packed WHERE NOT (container_id <= 8)")
def container_commit_failed(spark, d):
    """The first container of each lane fails: its entries go, entries at other addresses stay."""
    cache = _packed(spark, d).select("fp", F.col("container_id").alias("address"))
    failed = cache.where("address <= 8").unionByName(cache.where("address > 8").select("fp", F.lit(1).cast("long").alias("address")))
    return storage.drop_failed(cache, failed)


@query(", m AS (SELECT container_id, min(container_id) OVER (PARTITION BY container_id % 8) AS primary_id FROM (SELECT DISTINCT container_id FROM packed)) SELECT fp, primary_id AS address FROM packed JOIN m USING (container_id)")
def container_redirects(spark, d):
    """Every eighth container merged into the first of them: addresses follow the redirects."""
    packed = _packed(spark, d)
    ids = packed.select("container_id").distinct()
    first = ids.groupBy(F.expr("pmod(container_id, 8)").alias("lane")).agg(F.min("container_id").alias("primary_id"))
    redirects = ids.withColumn("lane", F.expr("pmod(container_id, 8)")).join(first, "lane").where("container_id <> primary_id").select("container_id", "primary_id")
    return storage.resolve(packed.select("fp", F.col("container_id").alias("address")), redirects)


@query()
def container_compression(spark, d):
    sealed = _stored(_chunks(spark, d)).mapInArrow(storage.seal("deflate"), storage.SEALED)
    return sealed.select("fp", "raw_size", F.octet_length("stored").cast("long").alias("item_size"))


@query(", h AS (SELECT fp, arg_max(block_id, log_id) AS hint FROM logt GROUP BY fp) SELECT hint - block_id AS diff, count(*) AS hits FROM logt JOIN h USING (fp) GROUP BY 1")
def block_locality_diffs(spark, d):
    """How far the block that last held a fingerprint is from the one that asks for it: what a locality cache learns."""
    log = tables.log(spark, d)
    hints = log.groupBy("fp").agg(F.max_by("block_id", "log_id").alias("hint"))
    return log.join(hints, "fp").groupBy((F.col("hint") - F.col("block_id")).alias("diff")).agg(F.count(F.lit(1)).alias("hits"))


@query(""", i AS (SELECT write_seq, block_id, bool_or(fp < '08' OR fp >= 'fc') AS bad FROM items GROUP BY ALL) SELECT write_seq, sum(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS miscompares, count(*) AS blocks FROM i GROUP BY write_seq""")
def verify_requests(spark, d):
    """Every block piece of every request is read back and compared with what was written; of the stored chunks some were changed (below 08), some are gone (from fc on)."""
    w = tables.writes(spark, d)
    c = _chunks(spark, d)
    pieces = chunking.split_blocks(w, BLOCK)
    ids = pieces.select("write_seq", "block", block_id(F.col("volume_id"), F.col("block") * BLOCK, BLOCK).alias("block_id"), F.col("block_offset").alias("lo"), (F.col("block_offset") + F.col("piece_size")).alias("hi"))
    zeros = F.unhex(F.repeat(F.lit("00"), F.octet_length("chunk")))
    stored = _stored(c).where("fp < 'fc'").select("fp", F.when(F.col("fp") < "08", zeros).otherwise(F.col("chunk")).alias("chunk"))
    got = mapping.read_range(mapping.block_items(c, BLOCK), stored, ids.select("block_id", "lo", "hi"))
    start = F.col("block") * BLOCK + F.col("lo") - F.col("offset")
    said = ids.join(w.select("write_seq", "offset", "data"), "write_seq").select("write_seq", "block_id", "lo", F.lower(F.hex(F.substring("data", (start + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")))).alias("want"))
    both = said.join(got.select("block_id", "lo", "data"), ["block_id", "lo"], "left")
    return both.groupBy("write_seq").agg(F.sum((~F.col("want").eqNullSafe(F.col("data"))).cast("long")).alias("miscompares"), F.count(F.lit(1)).alias("blocks"))
