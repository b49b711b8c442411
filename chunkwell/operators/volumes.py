"""Volumes: sizes, valid ranges, whole dumps, copies as a job that can go on, detaching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprints import block_id
from ..schemas import BLOCK_SHIFT, EMPTY_FP
from . import mapping
from .ranking import ranked

COPY_STEP = 64 << 20


def check_requests(requests: DataFrame, volumes: DataFrame) -> DataFrame:
    """requests (write_seq, volume_id, offset, size), volumes (volume_id, logical_size, maintenance) -> what each meets: ok, no_volume, not_ready or out_of_range."""
    both = requests.join(volumes, "volume_id", "left")
    end = F.col("offset") + F.col("size")
    bad = (F.col("offset") < 0) | (F.col("size") < 0) | (end > F.col("logical_size")) | (end > (1 << BLOCK_SHIFT))
    state = F.when(F.col("logical_size").isNull(), "no_volume").when(F.col("maintenance"), "not_ready").when(bad, "out_of_range").otherwise("ok")
    return both.select("write_seq", "volume_id", "offset", "size", state.alias("state"))


def resize(volumes: DataFrame, sizes: DataFrame) -> DataFrame:
    """volumes with the logical sizes of ``sizes`` (volume_id, logical_size); no block is touched, what lies beyond is out of range from now on."""
    new = sizes.select("volume_id", F.col("logical_size").alias("_new"))
    return volumes.join(new, "volume_id", "left").withColumn("logical_size", F.coalesce("_new", "logical_size")).drop("_new")


def blocks_of(volumes: DataFrame, items: DataFrame, block_size: int) -> DataFrame:
    """Items (block_id, ...) with the volume whose interval of block ids they lie in; ids outside of every interval drop out."""
    low = block_id(F.col("volume_id"), F.lit(0), block_size)
    spans = volumes.select("volume_id", low.alias("_low"), (low + F.ceil(F.col("logical_size") / block_size)).alias("_high"))
    shifted = items.withColumn("volume_id", F.shiftright("block_id", BLOCK_SHIFT).cast("int"))
    return shifted.join(spans, "volume_id").where("block_id >= _low and block_id < _high").drop("_low", "_high")


def dump(volumes: DataFrame, items: DataFrame, stored: DataFrame, block_size: int, offset: int = 0, size: int = 0) -> DataFrame:
    """(volume_id, offset, size, data) of a range of each volume in steps of one block, zeros where nothing was written; a size of 0 means up to the end."""
    end = F.when(F.lit(size) == 0, F.col("logical_size")).otherwise(F.least(F.col("logical_size"), F.lit(offset + size)))
    spans = volumes.select("volume_id", end.cast("long").alias("end")).where(F.col("end") > offset)
    first = offset // block_size
    steps = spans.select("volume_id", "end", F.explode(F.sequence(F.lit(first).cast("long"), F.floor((F.col("end") - 1) / block_size))).alias("block"))
    begin = F.greatest(F.lit(offset).cast("long"), F.col("block") * block_size)
    steps = steps.select("volume_id", begin.alias("offset"), (F.least("end", (F.col("block") + 1) * block_size) - begin).alias("size"), block_id(F.col("volume_id"), F.col("block") * block_size, block_size).alias("block_id"))
    ranges = steps.select("volume_id", "offset", "size", "block_id", F.pmod("offset", F.lit(block_size)).alias("lo")).withColumn("hi", F.col("lo") + F.col("size"))
    known = items.select("block_id").distinct()
    asked = ranges.select("block_id", "lo", "hi").join(known, "block_id", "left_semi")
    filled = mapping.fill_empty(asked, items, block_size)
    read = mapping.read_range(filled, stored, asked).select("block_id", "lo", "data")
    # Blocks that were never written need neither items nor a join on bytes.
    there = ranges.join(read, ["block_id", "lo"], "left").join(known.withColumn("known", F.lit(True)), "block_id", "left")
    zeros = F.repeat(F.lit("00"), F.col("size").cast("int"))
    return there.select("volume_id", "offset", "size", F.when(F.col("known"), F.col("data")).otherwise(zeros).alias("data"))


def copy_volume(jobs: DataFrame, items: DataFrame, block_size: int, step: int = COPY_STEP) -> tuple[DataFrame, DataFrame]:
    """jobs (src, dst, size, done): a copy that may have stopped at ``done`` goes on from there -> the steps still to do (src, dst, step, offset, size), and the
    items that they give the target volume. Blocks keep their places, so no item is cut; no bytes move.
    """
    if step % block_size:
        raise ValueError("a step is a number of whole blocks")
    todo = jobs.where("done < size").select("src", "dst", "size", "done", F.explode(F.expr(f"sequence(done, size - 1, {step}L)")).alias("offset"))
    steps = todo.select("src", "dst", F.floor((F.col("offset") - F.col("done")) / step).alias("step"), "offset", F.least(F.lit(step).cast("long"), F.col("size") - F.col("offset")).alias("size"))
    place = F.col("block_id").bitwiseAND(F.lit((1 << BLOCK_SHIFT) - 1)).cast("long")
    mine = items.withColumn("src", F.shiftright("block_id", BLOCK_SHIFT).cast("int")).withColumn("_block", place).join(jobs, "src")
    lo = F.col("_block") * block_size + F.col("item_start")
    hi = lo + F.col("item_size")
    begin, end = F.greatest(lo, F.col("done")), F.least(hi, F.col("size"))
    mine = mine.where((lo < F.col("size")) & (hi > F.col("done")))
    copied = mine.select(
        block_id(F.col("dst"), F.col("_block") * block_size, block_size).alias("block_id"), "fp", (begin - F.col("_block") * block_size).alias("item_start"),
        (F.col("chunk_offset") + begin - lo).alias("chunk_offset"), (end - begin).alias("item_size"),
    )
    return steps, copied


def detach(volumes: DataFrame, items: DataFrame, last_log_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """volumes (volume_id) to detach, items (block_id, fp, ...) of all volumes -> the items that stay, one delete event for each block that goes (log_id,
    block_id), and what the events take from the usage counts (log_id, fp, delta).
    """
    owner = items.withColumn("volume_id", F.shiftright("block_id", BLOCK_SHIFT).cast("int"))
    gone = owner.join(volumes.select("volume_id"), "volume_id", "left_semi")
    stay = owner.join(volumes.select("volume_id"), "volume_id", "left_anti").drop("volume_id")
    numbered = ranked(gone.select("block_id").distinct(), ["block_id"], F.floor(F.col("block_id") / (1 << 20)))
    events = numbered.select((F.col("rank") + last_log_id).alias("log_id"), "block_id")
    deltas = gone.where(F.col("fp") != EMPTY_FP).groupBy("block_id", "fp").agg((-F.count(F.lit(1))).alias("delta")).join(events, "block_id").select("log_id", "fp", "delta")
    return stay, events, deltas
