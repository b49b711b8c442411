"""Requests to blocks, and bytes to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNKERS, RabinOptions
from ..functions.fingerprints import fingerprint
from ..functions.rabin import cut_points


def split_blocks(writes: DataFrame, block_size: int) -> DataFrame:
    """A request's pieces, cut at block borders; the last is flagged."""
    first, end = F.floor(F.col("offset") / block_size), F.col("offset") + F.col("size")
    cut = writes.where("size > 0").select("write_seq", "volume_id", "offset", "size", F.explode(F.sequence(first, F.floor((end - 1) / block_size))).alias("block"))
    start, stop = F.greatest(F.col("offset"), F.col("block") * block_size), F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block_size)
    return cut.select("write_seq", "volume_id", "block", (start - F.col("block") * block_size).alias("block_offset"), (stop - start).alias("piece_size"), (stop == F.col("offset") + F.col("size")).alias("last"))


def static_chunks(writes: DataFrame, size: int = 8192, fp: str = "sha1") -> DataFrame:
    """Fixed-size chunks aligned to the volume's offsets; the first and last of a request may be short."""
    grid = F.floor(F.col("offset") / size)
    last = F.floor((F.col("offset") + F.col("total") - 1) / size) - grid

    def piece(k):
        start = F.greatest(F.lit(0), (grid + k) * size - F.col("offset"))
        return _piece(k, start, F.least(F.col("total"), (grid + k + 1) * size - F.col("offset")))

    # Bytes are sliced before rows are made: a row then holds its chunk, not a copy of the request.
    rows = writes.where("size > 0").withColumn("total", F.col("size"))
    cut = rows.select("write_seq", "volume_id", "source", "offset", F.inline(F.transform(F.sequence(F.lit(0).cast("long"), last), piece)))
    return cut.withColumn("fp", fingerprint(F.col("chunk"), fp)).select("write_seq", "volume_id", "source", "offset", "chunk_no", "start", "size", "fp", "chunk")


def _piece(number, start, stop, **more):
    return F.struct(
        number.cast("long").alias("chunk_no"), start.cast("long").alias("start"), (stop - start).cast("long").alias("size"), F.substring("data", (start + 1).cast("int"), (stop - start).cast("int")).alias("chunk"),
        *[c.alias(n) for n, c in more.items()],
    )


def spread(df: DataFrame) -> DataFrame:
    """Input that came as fewer files than there are cores (a small table is one) is dealt out; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def rabin_chunks(writes: DataFrame, options: RabinOptions = RabinOptions(), fp: str = "sha1") -> DataFrame:  # noqa: B008
    """Content-defined chunks of each request, with the reason of each cut. Cuts come from Python, bytes and digests from built-ins."""

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut_points(x.as_py(), options) for x in batch.column(batch.schema.get_field_index("data"))]
            kind = pa.list_(pa.struct([("end", pa.int64()), ("reason", pa.string())]))
            lists = pa.array([[{"end": e, "reason": r} for e, r in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "cuts"])

    rows = spread(writes.select("write_seq", "volume_id", "source", "offset", "data"))
    cut = rows.mapInArrow(cuts, "write_seq long, volume_id int, source string, offset long, data binary, cuts array<struct<end: long, reason: string>>")
    before = lambda k: F.coalesce(F.get("cuts", k - 1)["end"], F.lit(0).cast("long"))
    each = cut.select("write_seq", "volume_id", "source", "offset", F.inline(F.transform("cuts", lambda c, k: _piece(k, before(k), c["end"], reason=c["reason"]))))
    return each.withColumn("fp", fingerprint(F.col("chunk"), fp)).select("write_seq", "volume_id", "source", "offset", "chunk_no", "start", "size", "fp", "chunk", "reason")


def chunks_by_volume(writes: DataFrame, default: tuple[str, dict], volumes: dict[int, tuple[str, dict]]) -> DataFrame:
    """Chunks by each volume's own chunker (name and arguments), or the default one; one pass over the requests for each distinct choice."""
    own = lambda v: writes.where(F.col("volume_id") == v)
    parts = [CHUNKERS.get(name)(own(v), **args) for v, (name, args) in volumes.items()]
    name, args = default
    parts.append(CHUNKERS.get(name)(writes.where(~F.col("volume_id").isin(*volumes)) if volumes else writes, **args))
    columns = ["write_seq", "volume_id", "source", "offset", "chunk_no", "start", "size", "fp", "chunk"]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


CHUNKERS.add("static", static_chunks)
CHUNKERS.add("rabin", rabin_chunks)
