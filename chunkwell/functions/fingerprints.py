"""Column functions on chunk bytes and fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FINGERPRINTS, SAMPLERS
from ..schemas import BLOCK_SHIFT, EMPTY_FP

FINGERPRINTS.add("sha1", F.sha1)
FINGERPRINTS.add("md5", F.md5)
FINGERPRINTS.add("sha256", lambda c: F.sha2(c, 256))
FINGERPRINTS.add("sha512", lambda c: F.sha2(c, 512))


def fingerprint(chunk: Column, kind: str = "sha1") -> Column:
    """Lower-case hex digest of a chunk."""
    return FINGERPRINTS.get(kind)(chunk)


def zero_rewrite(chunk: Column, size: Column, fp: Column, full: int) -> Column:
    """The empty fingerprint for a chunk of full size that is all zeros."""
    return F.when((size == full) & (F.rtrim(F.hex(chunk), F.lit("0")) == ""), F.lit(EMPTY_FP)).otherwise(fp)


def sample_mask(factor: int) -> int:
    """Ones tested by suffix sampling: one more bit for each doubling, one at least."""
    if factor < 1 or factor & (factor - 1):
        raise ValueError("the factor must be a power of two")
    return (1 << max(1, (factor - 1).bit_length())) - 1


def is_anchor(fp: Column, factor: int) -> Column:
    """Whether the last four bytes, read least byte first, end in ones."""
    tail = F.concat(*[F.substring(fp, -2 * k, 2) for k in (1, 2, 3, 4)])
    return F.conv(tail, 16, 10).cast("long").bitwiseAND(F.lit(sample_mask(factor)).cast("long")) == sample_mask(factor)


SAMPLERS.add("sampling", is_anchor)
SAMPLERS.add("full", lambda fp, factor=1: F.lit(True))


def block_id(volume: Column, offset: Column, block_size: int) -> Column:
    return F.shiftleft(volume.cast("long"), BLOCK_SHIFT).bitwiseOR(F.floor(offset / block_size).cast("long"))


def bloom_size(n: int, error: float) -> tuple[int, int]:
    """(hash functions, bits) of a membership set for n keys."""
    k = math.ceil(math.log2(1 / error))
    per_hash = math.ceil(2 * n * abs(math.log(error)) / (k * math.log(2) ** 2))
    return k, -(-k * per_hash // 32) * 32
