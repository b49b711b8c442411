"""Hashes and codecs that Spark has no equal of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers and rotations of 32-bit Murmur3.
C1, C2, C3 = 0xCC9E2D51, 0x1B873593, 0xE6546B64
F1, F2 = 0x85EBCA6B, 0xC2B2AE35


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def murmur3(values: list[bytes], seed: int = 0) -> np.ndarray:
    """32-bit Murmur3 of all values at once: a step takes the next word of every value that still has one."""
    sizes = np.array([len(v) for v in values], np.int64)
    state = np.full(len(values), seed, np.uint32)
    order = np.argsort(-sizes, kind="stable")  # longest first, so that those with a word at a step are a prefix
    words = sizes[order] // 4
    padded = b"".join(values[k] + bytes(-len(values[k]) % 4) for k in order)
    flat = np.frombuffer(padded, "<u4")
    begin = np.concatenate([[0], np.cumsum((sizes[order] + 3) // 4)])[:-1] if len(values) else sizes
    h = state[order]
    mix = lambda k: _turn(k * np.uint32(C1), 15) * np.uint32(C2)
    with np.errstate(over="ignore"):
        for step in range(int(words[0]) if len(values) else 0):
            n = int(np.searchsorted(-words, -step, "left"))
            h[:n] = _turn(h[:n] ^ mix(flat[begin[:n] + step]), 13) * np.uint32(5) + np.uint32(C3)
        tail = np.flatnonzero(sizes[order] % 4)
        h[tail] ^= mix(flat[begin[tail] + words[tail]])
        h ^= sizes[order].astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(F1)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(F2)
        h ^= h >> np.uint32(16)
    state[order] = h
    return state


def murmur3_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow on (key, bytes): key and the bytes' hash; null counts as empty."""
    for batch in batches:
        hashes = murmur3([x.as_py() or b"" for x in batch.column(1)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes.astype(np.int64))], ["key", "murmur3"])


def rot13(text: Column) -> Column:
    """Letters moved by half the alphabet; its own inverse."""
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    return F.translate(text, upper + lower, upper[13:] + upper[:13] + lower[13:] + lower[:13])


# Multipliers of the 64-bit form of 128-bit Murmur3, additive constants and final multipliers.
D1, D2, ADD1, ADD2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0x52DCE729, 0x38495AB5
E1, E2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
# Multipliers and additive constants of its 32-bit form.
X_MULTIPLIERS, X_ADDED = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93), (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)
X_TURNS, X_STATE_TURNS = (15, 16, 17, 18), (19, 17, 15, 13)


def _round_bytes(value: bytes, width: int) -> tuple[list[list[int]], list[int]]:
    """Whole 16-byte blocks as words of ``width`` bytes, and the words of the padded rest."""
    words = [int.from_bytes(value[k : k + width], "little") for k in range(0, len(value), width)]
    per = 16 // width
    whole = len(value) // 16 * per
    rest = words[whole:]
    return [words[k : k + per] for k in range(0, whole, per)], rest + [0] * (per - len(rest))


def _final(h: int, bits: int) -> int:
    shifts, factors = ((33, 33, 33), (E1, E2)) if bits == 64 else ((16, 13, 16), (F1, F2))
    for shift, factor in zip(shifts, (*factors, 1), strict=True):
        h = (h ^ h >> shift) * factor % (1 << bits)
    return h


def _rotated(x: int, by: int, bits: int) -> int:
    return (x << by | x >> (bits - by)) % (1 << bits)


def murmur3_x64_128(value: bytes, seed: int = 0) -> tuple[int, int]:
    """The two 64-bit halves of 128-bit Murmur3 for 64-bit machines."""
    top = 1 << 64
    scrambled = lambda a, b: (_rotated(a * D1 % top, 31, 64) * D2 % top, _rotated(b * D2 % top, 33, 64) * D1 % top)
    blocks, rest = _round_bytes(value, 8)
    h = g = seed
    for a, b in blocks:
        x, y = scrambled(a, b)
        h = ((_rotated(h ^ x, 27, 64) + g) * 5 + ADD1) % top
        g = ((_rotated(g ^ y, 31, 64) + h) * 5 + ADD2) % top
    x, y = scrambled(*rest)
    h, g = h ^ x ^ len(value), g ^ y ^ len(value)
    h = (h + g) % top
    g = (g + h) % top
    h, g = _final(h, 64), _final(g, 64)
    h = (h + g) % top
    return h, (g + h) % top


def murmur3_x86_128(value: bytes, seed: int = 0) -> tuple[int, int, int, int]:
    """The four 32-bit words of 128-bit Murmur3 for 32-bit machines."""
    top, lanes = 1 << 32, range(4)
    scrambled = lambda words: [_rotated(words[k] * X_MULTIPLIERS[k] % top, X_TURNS[k], 32) * X_MULTIPLIERS[(k + 1) % 4] % top for k in lanes]
    blocks, rest = _round_bytes(value, 4)
    h = [seed] * 4
    for words in blocks:
        for k, x in enumerate(scrambled(words)):
            h[k] = ((_rotated(h[k] ^ x, X_STATE_TURNS[k], 32) + h[(k + 1) % 4]) * 5 + X_ADDED[k]) % top
    h = [a ^ x ^ len(value) for a, x in zip(h, scrambled(rest), strict=True)]

    def spread() -> None:
        h[0] = sum(h) % top
        h[1:] = [(x + h[0]) % top for x in h[1:]]

    spread()
    h[:] = [_final(x, 32) for x in h]
    spread()
    return tuple(h)


def murmur3_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow on (key, bytes): key, the halves of the 64-bit form (signed) and the words of the 32-bit form."""
    for batch in batches:
        values = [x.as_py() or b"" for x in batch.column(1)]
        halves = np.array([murmur3_x64_128(v) for v in values], np.uint64).reshape(-1, 2).view(np.int64)
        words = np.array([murmur3_x86_128(v) for v in values], np.int64).reshape(-1, 4)
        columns = [batch.column(0), *[pa.array(c) for c in halves.T.copy()], *[pa.array(c) for c in words.T.copy()]]
        yield pa.RecordBatch.from_arrays(columns, ["key", "low", "high", "w0", "w1", "w2", "w3"])
