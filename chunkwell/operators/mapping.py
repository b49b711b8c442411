"""Block mappings: items that tile blocks, their overlay, differences, reads and copies."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprints import block_id
from ..schemas import EMPTY_FP, MAX_CHUNK


def block_items(chunks: DataFrame, block_size: int) -> DataFrame:
    """One item per chunk and block it lies in; ``chunk_offset`` is where in the chunk the item begins."""
    begin = F.col("offset") + F.col("start")
    cut = chunks.select("write_seq", "chunk_no", "volume_id", "fp", begin.alias("begin"), "size", F.explode(F.sequence(F.floor(begin / block_size), F.floor((begin + F.col("size") - 1) / block_size))).alias("block"))
    lo, hi = F.greatest("begin", F.col("block") * block_size), F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_size)
    return cut.select("write_seq", "chunk_no", block_id(F.col("volume_id"), F.col("block") * block_size, block_size).alias("block_id"), "fp", (lo - F.col("block") * block_size).alias("item_start"), (lo - F.col("begin")).alias("chunk_offset"), (hi - lo).alias("item_size"))


OVERLAID = "block_id long, seq long, fp string, item_start long, chunk_offset long, item_size long"


def overlay(items: DataFrame) -> DataFrame:
    """What later writes leave of earlier ones: (block_id, seq, fp, item_start, chunk_offset, item_size), last writer wins.

    Items are sorted once by block and beginning, and swept as a stream: n log n steps, however often a block's bytes were overwritten. Of two items of one seq
    the one that begins later is on top.
    """
    whole = lambda c: F.col(c).cast("long").alias(c)
    rows = items.where("item_size > 0").select(whole("block_id"), whole("seq"), "fp", whole("item_start"), whole("chunk_offset"), whole("item_size"))
    return rows.repartition("block_id").sortWithinPartitions("block_id", "item_start", "seq").mapInArrow(_swept, OVERLAID)


class _Stairs:
    """The items of one block that are open at a place and may still be seen: the higher the seq, the sooner the end. So there are never more than the block has bytes."""

    def __init__(self, block: int):
        self.block, self.at = block, 0
        self.open: list[tuple[int, int, int, tuple]] = []  # (seq, start, end, row), by seq
        self.runs: list[list] = []  # [row, begin, end]

    def move(self, to: float) -> None:
        """Goes on to a place; what is on top on the way is seen."""
        while self.open and self.at < to:
            _, _, end, row = self.open[-1]
            if end <= self.at:
                self.open.pop()
                continue
            stop = min(end, to)
            if self.runs and self.runs[-1][0] is row and self.runs[-1][2] == self.at:
                self.runs[-1][2] = stop
            else:
                self.runs.append([row, self.at, stop])
            self.at = stop
        self.at = to

    def add(self, seq: int, start: int, end: int, row: tuple) -> None:
        k = bisect(self.open, (seq, start, end))
        if k < len(self.open) and self.open[k][2] >= end:
            return  # hidden for as long as it lasts
        while k and self.open[k - 1][2] <= end:
            k -= 1
            del self.open[k]
        self.open.insert(k, (seq, start, end, row))

    def seen(self) -> list[tuple]:
        self.move(float("inf"))
        return [(self.block, row[0], row[1], lo, row[3] + lo - row[2], hi - lo) for row, lo, hi in self.runs]


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow on items in order of block and beginning: the runs that are seen."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in OVERLAID.split(", ")]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)
    stairs = None
    for batch in batches:
        out: list[tuple] = []
        for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if stairs is None or stairs.block != block:
                out += stairs.seen() if stairs else []
                stairs = _Stairs(block)
            seq, _, start, _, size = row
            stairs.move(start)
            stairs.add(seq, start, start + size, tuple(row))
        yield table(out)
    if stairs:
        yield table(stairs.seen())


def mapping_check(items: DataFrame, block_size: int, most: int = MAX_CHUNK) -> DataFrame:
    """Per block: bytes, items, and whether it is sound: sizes add up to the block's, no item is empty or larger than a chunk, none begins further into
    its chunk than a chunk may be long. (Items follow each other in a stored mapping, so a gap shows as a sum that is too small.)
    """
    good = (F.col("item_size") > 0) & (F.col("item_size") <= most) & (F.col("chunk_offset") <= most)
    per = items.groupBy("block_id").agg(F.sum("item_size").alias("bytes"), F.count(F.lit(1)).alias("items"), F.bool_and(good).alias("good"))
    return per.select("block_id", "bytes", "items", (F.col("good") & (F.col("bytes") == block_size)).alias("ok"))


def usage_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per block and fingerprint: occurrences after minus before; zeros and the empty fingerprint are left out. If both have a data_address, so has the
    result: the new version's where it has the fingerprint.
    """
    placed = "data_address" in before.columns and "data_address" in after.columns
    more = ["data_address"] if placed else []
    signed = before.select("block_id", "fp", *more, F.lit(-1).alias("s")).unionAll(after.select("block_id", "fp", *more, F.lit(1).alias("s")))
    address = [F.max_by("data_address", F.struct("s", "data_address")).alias("data_address")] if placed else []
    return signed.where(F.col("fp") != EMPTY_FP).groupBy("block_id", "fp").agg(F.sum("s").alias("delta"), *address).where("delta <> 0")


def read_range(items: DataFrame, stored: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (block_id, lo, hi) -> (block_id, lo, hi, data): item slices in order. stored: (fp, chunk), or (fp, data_address, chunk) if items have an address too.

    Empty items read as zeros; a range with an item that nothing stores is null, not short. Only chunks that the ranges need are moved: they are
    picked by name before any join touches their bytes.
    """
    r, i = ranges.alias("r"), items.alias("i")
    key = ["fp", "data_address"] if "data_address" in items.columns and "data_address" in stored.columns else ["fp"]
    hit = r.join(i, (F.col("r.block_id") == F.col("i.block_id")) & (F.col("i.item_start") < F.col("r.hi")) & (F.col("i.item_start") + F.col("i.item_size") > F.col("r.lo")))
    begin = F.greatest("r.lo", "i.item_start")
    size = F.least(F.col("r.hi"), F.col("i.item_start") + F.col("i.item_size")) - begin
    hit = hit.select("r.block_id", "r.lo", "r.hi", *[F.col(f"i.{k}") for k in key], begin.alias("begin"), size.cast("int").alias("size"), (F.col("i.chunk_offset") + begin - F.col("i.item_start")).cast("int").alias("from"))
    held = stored.join(hit.select(*key).distinct(), key, "left_semi").select(*key, "chunk")
    got = hit.join(held, key, "left")
    piece = F.when(F.col("fp") == EMPTY_FP, F.repeat(F.lit("00"), F.col("size"))).otherwise(F.hex(F.substring("chunk", F.col("from") + 1, F.col("size"))))
    parts = got.select("block_id", "lo", "hi", "begin", piece.alias("piece")).groupBy("block_id", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("begin", "piece"))).alias("p"))
    return parts.select("block_id", "lo", "hi", F.when(~F.exists("p", lambda x: x["piece"].isNull()), F.lower(F.array_join(F.transform("p", lambda x: x["piece"]), ""))).alias("data"))


def fast_copy(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs (src, dst, lo, hi): the source's items in [lo, hi) as items of the target, no bytes moved."""
    j, i = jobs.alias("j"), items.alias("i")
    hit = j.join(i, (F.col("j.src") == F.col("i.block_id")) & (F.col("i.item_start") < F.col("j.hi")) & (F.col("i.item_start") + F.col("i.item_size") > F.col("j.lo")))
    lo, hi = F.greatest("j.lo", "i.item_start"), F.least(F.col("j.hi"), F.col("i.item_start") + F.col("i.item_size"))
    return hit.select(F.col("j.dst").alias("block_id"), "i.fp", lo.alias("item_start"), (F.col("i.chunk_offset") + lo - F.col("i.item_start")).alias("chunk_offset"), (hi - lo).alias("item_size"))


ITEM = ("block_id", "fp", "item_start", "chunk_offset", "item_size")


def cut(items: DataFrame, at: int) -> DataFrame:
    """Blocks truncated at an offset."""
    return items.where(F.col("item_start") < at).select("block_id", "fp", "item_start", "chunk_offset", F.least(F.col("item_size"), F.lit(at) - F.col("item_start")).alias("item_size"))


def fill_empty(blocks: DataFrame, items: DataFrame, block_size: int) -> DataFrame:
    """Items of the blocks asked for (block_id), with empty items wherever nothing was written, missing blocks included."""
    asked = blocks.select("block_id").distinct()
    held = items.join(asked, "block_id", "left_semi").select(*ITEM)
    # A marker of no size at either end makes every gap one between neighbours.
    marks = asked.select("block_id", F.explode(F.array(F.lit(0), F.lit(block_size)).cast("array<long>")).alias("item_start"), F.lit(0).cast("long").alias("item_size"))
    order = Window.partitionBy("block_id").orderBy("item_start", "item_size")
    ends = held.select("block_id", "item_start", "item_size").unionByName(marks).withColumn("next", F.lead("item_start").over(order))
    gaps = ends.select("block_id", (F.col("item_start") + F.col("item_size")).alias("lo"), F.col("next").alias("hi")).where("hi > lo")
    pieces = gaps.select("block_id", "lo", "hi", F.explode(F.expr(f"sequence(lo, hi - 1, {MAX_CHUNK}L)")).alias("at"))
    empty = pieces.select("block_id", F.lit(EMPTY_FP).alias("fp"), F.col("at").alias("item_start"), F.lit(0).cast("long").alias("chunk_offset"), F.least(F.col("hi") - F.col("at"), F.lit(MAX_CHUNK).cast("long")).alias("item_size"))
    return held.unionByName(empty)


def merge_parts(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs (seq, src, dst, src_lo, dst_lo, size), seq from 1 -> the target blocks after each got its slices of the sources, in order of seq.

    Sources are read as they were before the jobs.
    """
    j, i = jobs.alias("j"), items.alias("i")
    stop, end = F.col("j.src_lo") + F.col("j.size"), F.col("i.item_start") + F.col("i.item_size")
    hit = j.join(i, (F.col("j.src") == F.col("i.block_id")) & (F.col("i.item_start") < stop) & (end > F.col("j.src_lo")))
    lo, hi = F.greatest("j.src_lo", "i.item_start"), F.least(stop, end)
    moved = hit.select(
        F.col("j.dst").alias("block_id"), F.col("j.seq").cast("long").alias("seq"), "i.fp", (lo - F.col("j.src_lo") + F.col("j.dst_lo")).alias("item_start"),
        (F.col("i.chunk_offset") + lo - F.col("i.item_start")).alias("chunk_offset"), (hi - lo).alias("item_size"),
    )
    targets = jobs.select(F.col("dst").alias("block_id")).distinct()
    old = items.join(targets, "block_id", "left_semi").select("block_id", F.lit(0).cast("long").alias("seq"), "fp", "item_start", "chunk_offset", "item_size")
    return overlay(old.unionByName(moved)).select(*ITEM)


def copy_steps(jobs: DataFrame, block_size: int) -> DataFrame:
    """jobs (job, src_offset, dst_offset, size) -> steps within which neither side crosses a block border."""
    past = lambda c: F.lit(block_size).cast("long") - F.pmod(F.col(c), F.lit(block_size))  # noqa: E731  to the first border
    borders = lambda c: F.when(past(c) < F.col("size"), F.sequence(past(c), F.col("size") - 1, F.lit(block_size).cast("long"))).otherwise(F.array().cast("array<long>"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), borders("src_offset"), borders("dst_offset"))))
    each = jobs.where("size > 0").withColumn("cuts", cuts).select("*", F.posexplode("cuts").alias("k", "lo")).withColumn("hi", F.coalesce(F.get("cuts", F.col("k") + 1), F.col("size")))
    return each.select("job", (F.col("src_offset") + F.col("lo")).alias("src_offset"), (F.col("dst_offset") + F.col("lo")).alias("dst_offset"), (F.col("hi") - F.col("lo")).alias("size"))


def pair_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """before and after (block_id, pos, fp, size) -> items of the new version with their change of the usage count.

    The first occurrence of a fingerprint carries its block's difference, repeats carry 0; fingerprints that only the old version has
    follow as items of no size and place, unless empty. Items of size 0 count for nothing.
    """
    old = before.where("size > 0").groupBy("block_id", "fp").agg(F.count(F.lit(1)).alias("n_old"))
    new = after.where("size > 0")
    first = new.groupBy("block_id", "fp").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_new"))
    diff = first.join(old, ["block_id", "fp"], "left").select("block_id", "fp", "first_pos", (F.col("n_new") - F.coalesce("n_old", F.lit(0))).alias("delta"))
    kept = new.join(diff, ["block_id", "fp"]).select("block_id", "pos", "fp", "size", F.when(F.col("pos") == F.col("first_pos"), F.col("delta")).otherwise(0).alias("modifier"))
    gone = old.where(F.col("fp") != EMPTY_FP).join(first, ["block_id", "fp"], "left_anti")
    return kept.unionByName(gone.select("block_id", F.lit(None).cast("long").alias("pos"), "fp", F.lit(0).cast("long").alias("size"), (-F.col("n_old")).alias("modifier")))


def equal_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per block of either mapping: whether both have the same items."""
    signed = a.select(*ITEM, F.lit(1).alias("s")).unionAll(b.select(*ITEM, F.lit(-1).alias("s")))
    return signed.groupBy(*ITEM).agg(F.sum("s").alias("s")).groupBy("block_id").agg(F.bool_and(F.col("s") == 0).alias("equal"))


def checksum(items: DataFrame) -> DataFrame:
    """SHA-256 of each block's items in order."""
    listed = F.sort_array(F.collect_list(F.struct("item_start", "item_size", "fp", "chunk_offset")))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["item_start"], x["item_size"], x["fp"], x["chunk_offset"])), ",")
    return items.groupBy("block_id").agg(F.sha2(text, 256).alias("checksum"))
