"""First occurrences, the chunk index and the filter chain.

Whether a chunk was seen before is decided by (write_seq, chunk_no). First places come from partial
aggregation, not from windows, so a frequent fingerprint loads no task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FILTERS, SAMPLERS
from ..functions import fingerprints as _fingerprints  # noqa: F401  registers the samplers
from ..schemas import EMPTY_ADDRESS, EMPTY_FP

EXISTING, STRONG, WEAK, NEW, ERROR = 4, 3, 2, 1, 0


def chunk_index(chunks: DataFrame) -> DataFrame:
    """fp -> its first place, size and number of uses."""
    return chunks.groupBy("fp").agg(F.min(F.struct("write_seq", "chunk_no")).alias("f"), F.max("size").alias("size"), F.count(F.lit(1)).alias("usage_count")).select("fp", F.col("f.write_seq").alias("first_seq"), F.col("f.chunk_no").alias("first_no"), "size", "usage_count")


def with_first(chunks: DataFrame) -> DataFrame:
    """Chunks with ``is_new``: whether this is the first place of its fingerprint."""
    index = chunk_index(chunks).select("fp", "first_seq", "first_no")
    return chunks.join(index, "fp").withColumn("is_new", (F.col("write_seq") == F.col("first_seq")) & (F.col("chunk_no") == F.col("first_no")))


def ratio(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Chunks, distinct chunks, logical and physical bytes, and their ratio."""
    per = chunks.groupBy(*by, "fp").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    out = per.groupBy(*by).agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum(F.col("n") * F.col("size")).alias("logical_bytes"), F.sum("size").alias("physical_bytes"))
    return out.withColumn("dedup_ratio", F.round(F.col("logical_bytes") / F.col("physical_bytes"), 6))


# Filters: each adds its columns to the chunks and says what it makes of them.


def zero_filter(chunks: DataFrame, **_) -> tuple[DataFrame, Column, Column | None]:
    return chunks, F.when(F.col("fp") == EMPTY_FP, EXISTING).otherwise(WEAK), F.when(F.col("fp") == EMPTY_FP, F.lit(-2).cast("long"))


def sampling_filter(chunks: DataFrame, factor: int | None = 32, **_) -> tuple[DataFrame, Column, Column | None]:
    """Marks anchors; without a factor every chunk is one."""
    anchor = SAMPLERS.get("full")(F.col("fp")) if factor is None else SAMPLERS.get("sampling")(F.col("fp"), factor)
    return chunks.withColumn("indexed", anchor), F.lit(WEAK), None


def block_filter(chunks: DataFrame, previous: DataFrame, **_) -> tuple[DataFrame, Column, Column | None]:
    """previous: (block_id, fp, block_address), one row for each fingerprint that the block's last mapping holds."""
    out = chunks.join(previous, ["block_id", "fp"], "left")
    return out, F.when(F.col("block_address").isNotNull(), STRONG).otherwise(WEAK), F.col("block_address")


def index_filter(chunks: DataFrame, index: DataFrame, accepting: bool = True, **_) -> tuple[DataFrame, Column, Column | None]:
    """index: (fp, index_address). Chunks that sampling left out are not looked up; one that a full index lacks is an error."""
    out = chunks.join(index, "fp", "left")
    looked = F.col("indexed") if "indexed" in chunks.columns else F.lit(True)
    verdict = F.when(~looked, WEAK).when(F.col("index_address").isNotNull(), STRONG).otherwise(NEW if accepting else ERROR)
    return out, verdict, F.when(looked, F.col("index_address"))


def bloom_filter(chunks: DataFrame, index: DataFrame, **_) -> tuple[DataFrame, Column, Column | None]:
    """Exact membership in place of a bloom set: absent is new, present is open."""
    out = chunks.join(index.select("fp", F.lit(True).alias("in_bloom")), "fp", "left")
    return out, F.when(F.col("fp") == EMPTY_FP, WEAK).when(F.col("in_bloom"), WEAK).otherwise(NEW), None


def bytes_filter(chunks: DataFrame, stored: DataFrame, **_) -> tuple[DataFrame, Column, Column | None]:
    """stored: (fp, stored_address, stored_chunk). A chunk with an address is compared with what is stored there: equal bytes exist; others, shorter ones or
    none at all are an error, never a new chunk. Without an address it is new; the empty address always exists; a row without bytes stays open.
    """
    held = stored.select("fp", F.col("stored_address").alias("address"), "stored_chunk")
    out = chunks.join(held, ["fp", "address"], "left")
    verdict = (
        F.when(F.col("chunk").isNull(), WEAK).when(F.col("address").isNull(), NEW).when(F.col("address") == EMPTY_ADDRESS, EXISTING)
        .when(F.col("stored_chunk") == F.col("chunk"), EXISTING).otherwise(ERROR)
    )
    return out, verdict, None


def locality_filter(chunks: DataFrame, locality: DataFrame, **_) -> tuple[DataFrame, Column, Column | None]:
    """locality: (block_id, fp, cached_address), what the locality cache held when the block was written."""
    out = chunks.join(locality, ["block_id", "fp"], "left")
    return out, F.when(F.col("cached_address").isNotNull(), STRONG).otherwise(WEAK), F.col("cached_address")


_FILTERS = (
    ("zerochunk-filter", zero_filter), ("sampling-filter", sampling_filter), ("block-index-filter", block_filter), ("block-locality-filter", locality_filter),
    ("chunk-index-filter", index_filter), ("bloom-filter", bloom_filter), ("bytecompare-filter", bytes_filter),
)
for _name, _filter in _FILTERS:
    FILTERS.add(_name, _filter)


def said_by(name: str) -> str:
    return "said_" + name.replace("-", "_")


def chain(chunks: DataFrame, names: Sequence[str] = ("block-index-filter", "chunk-index-filter"), **sources) -> DataFrame:
    """Chunks with ``decision`` and ``address`` after a chain of filters, and what each filter said (null: not asked).

    A filter is asked while the decision is weak; where it is strong, only one that can say EXISTING is; EXISTING, NEW and errors are final.
    An address once found stays, and a chunk is known where there is one. An error aborts the chunk: it has no address and is not known, whatever
    an earlier filter found; ``errors`` lists such rows.
    """
    if len(set(names)) < len(names):
        raise ValueError("a filter occurs twice")
    out = chunks.withColumn("decision", F.lit(WEAK)).withColumn("address", F.lit(None).cast("long"))
    for name in names:
        out, verdict, address = FILTERS.get(name)(out, **sources)
        asked = F.col("decision") == WEAK
        if name in ("zerochunk-filter", "bytecompare-filter"):
            asked = asked | (F.col("decision") == STRONG)
        out = out.withColumn(said_by(name), F.when(asked, verdict))
        if address is not None:
            out = out.withColumn("address", F.coalesce("address", F.when(asked, address)))
        out = out.withColumn("decision", F.coalesce(said_by(name), "decision"))
    failed = F.col("decision") == ERROR
    return out.withColumn("address", F.when(~failed, F.col("address"))).withColumn("known", F.col("address").isNotNull())


def errors(decided: DataFrame) -> DataFrame:
    """The rows that a filter refused, for whoever must look at them; nothing is stored for them."""
    return decided.where(F.col("decision") == ERROR)


def counters(decided: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per filter of a chain: how many chunks it was asked for, and what it said."""
    said = F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(said_by(n)).alias("said")) for n in names]))
    rows = decided.select(said.alias("x")).select("x.*").where("said is not null")
    count = lambda k: F.count(F.when(F.col("said") == k, 1))
    return rows.groupBy("filter").agg(
        F.count(F.lit(1)).alias("reads"), count(EXISTING).alias("existing"), count(STRONG).alias("strong_hits"), count(WEAK).alias("weak_hits"), count(NEW).alias("misses"), count(ERROR).alias("failures")
    )


def filters_for(names: Sequence[str] | None, default: Sequence[str] = ("block-index-filter", "chunk-index-filter")) -> tuple[str, ...]:
    """A volume's own filters, all of which must exist, or else the default ones."""
    for name in names or ():
        FILTERS.get(name)
    return tuple(names or default)


def learn(index: DataFrame, decided: DataFrame) -> DataFrame:
    """The index (fp, index_address) after a chain's update phase: new, indexed chunks enter at their first request; known ones leave it as it is, and what
    an error aborted leaves no trace.
    """
    fresh = decided.where(~F.col("known") & (F.col("decision") != ERROR))
    if "indexed" in decided.columns:
        fresh = fresh.where("indexed")
    fresh = fresh.groupBy("fp").agg(F.min("write_seq").alias("index_address")).join(index, "fp", "left_anti")
    return index.select("fp", "index_address").unionByName(fresh)


def update_known(index: DataFrame, decided: DataFrame) -> DataFrame:
    """The index (fp, index_address, block_hint) after known chunks told it the block that used them last."""
    last = decided.where("known").groupBy("fp").agg(F.max_by("block_id", F.struct("write_seq", "chunk_no")).alias("_hint"))
    return index.join(last, "fp", "left").withColumn("block_hint", F.coalesce("_hint", "block_hint")).drop("_hint")


def accepts_new(index: DataFrame, capacity: int, share: float = 0.9) -> DataFrame:
    """One row: how many items the index has, and whether new chunks may still enter."""
    return index.agg(F.count(F.lit(1)).alias("items")).select("items", F.lit(capacity).cast("long").alias("capacity"), (F.col("items") < share * capacity).alias("accepting"))


# Keyed tables


def two_tier(main: DataFrame, aux: DataFrame, key: str) -> DataFrame:
    """The table as read through an auxiliary tier, whose rows hide main ones of the same key."""
    return main.join(aux.select(key), key, "left_anti").unionByName(aux)


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key wins over the table."""
    rest = [c for c in table.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*")
    return table.join(last.select(key), key, "left_anti").unionByName(last)


def put_if_absent(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The first change of a key that the table lacks."""
    rest = [c for c in table.columns if c != key]
    first = changes.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("v")).select(key, "v.*")
    return table.unionByName(first.join(table.select(key), key, "left_anti"))


def compare_and_swap(table: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """changes: (key, expected, value). The table with values replaced where the expected one was found, and whether it was."""
    both = table.join(changes.withColumnRenamed(value, "_new"), key, "left")
    hit = F.col("expected").eqNullSafe(F.col(value)) & F.col("_new").isNotNull()
    return both.select(key, F.when(hit, F.col("_new")).otherwise(F.col(value)).alias(value), F.coalesce(hit, F.lit(False)).alias("swapped"))


def persist_dirty(main: DataFrame, aux: DataFrame, pinned: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tiers after dirty rows were written through: auxiliary rows go to the main tier and leave the auxiliary one, but for pinned keys, which stay where they are."""
    loose = aux.join(pinned.select(key), key, "left_anti")
    return two_tier(main, loose, key), aux.join(pinned.select(key), key, "left_semi")


def cursor(table: DataFrame, key: str, at=None) -> dict[str, DataFrame]:
    """What an ordered cursor reaches from a key: the first and the last row, the first at or behind it, and the one after that. Each is one row at most, found by a top-k, not a sort."""
    ahead = table.where(F.col(key) >= F.lit(at)) if at is not None else table
    here = ahead.orderBy(key).limit(1)
    return {
        "first": table.orderBy(key).limit(1), "last": table.orderBy(F.desc(key)).limit(1), "jump": here,
        "next": ahead.join(F.broadcast(here.select(key)), key, "left_anti").orderBy(key).limit(1),  # one row
    }
