"""Content-defined chunking by a rolling polynomial over GF(2), on numpy arrays.

The hash of a window is linear in its bytes, so hashes of all full windows come from one table lookup for two
window bytes over the whole array. After each cut the window starts empty; its first bytes are summed up one by one.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from ..config import RabinOptions


def reduced(value: int, polynomial: int) -> int:
    """value mod polynomial over GF(2)."""
    degree = polynomial.bit_length() - 1
    while value.bit_length() > degree:
        value ^= polynomial << (value.bit_length() - 1 - degree)
    return value


def product(a: int, b: int, polynomial: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = a << 1, b >> 1
    return reduced(out, polynomial)


@cache
def append_table(polynomial: int) -> tuple[int, ...]:
    """What the top byte adds when the hash moves up by eight bits, its own lowest bit included."""
    degree = polynomial.bit_length() - 1
    unit = reduced(1 << degree, polynomial)
    return tuple(product(j, unit, polynomial) | (j << degree) & (2**64 - 1) for j in range(256))


@cache
def drop_table(polynomial: int, window: int) -> tuple[int, ...]:
    """What a byte contributes once it is the oldest of a window."""
    unit = reduced(1 << 8 * (window - 1), polynomial)
    return tuple(product(j, unit, polynomial) for j in range(256))


@cache
def pair_tables(polynomial: int, window: int) -> np.ndarray:
    """Low 16 bits of what two adjacent bytes contribute, by the age of the younger one. A cut depends on no more bits, as an average is 65536 at most."""
    units = [reduced(1 << 8 * k, polynomial) for k in range(window)]
    single = np.array([[product(j, u, polynomial) & 0xFFFF for j in range(256)] for u in units], np.uint16)
    pairs = [(single[k + 1][:, None] ^ single[k][None]).ravel() for k in range(0, window - 1, 2)]
    if window % 2:
        pairs.append(np.repeat(single[window - 1], 256).reshape(256, 256).ravel())  # by the elder byte of the pair, the younger one counts elsewhere
    return np.array(pairs)


SLICE = 1 << 15


def window_hashes(data: np.ndarray, options: RabinOptions) -> np.ndarray:
    """Low 16 bits of the hash of the window that ends at each byte, from the first full window on.

    One lookup for two bytes of a window, over the whole array at once; tables and a slice of the array stay in the processor's cache.
    """
    tables, window, n = pair_tables(options.polynomial, options.window), options.window, len(data) - options.window + 1
    out = np.zeros(max(0, n), np.uint16)
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        part = data[max(0, lo - 1) : hi + window - 1].astype(np.intp)
        shift = lo - max(0, lo - 1)
        pair = np.empty(len(part), np.intp)  # the byte before and the byte at each place
        pair[0] = part[0]
        pair[1:] = part[:-1] << 8 | part[1:]
        total = out[lo:hi]
        for k in range(0, window, 2):
            at = shift + window - 1 - k
            if k == window - 1:  # the eldest byte of an odd window has no elder one
                total ^= tables[k // 2][part[at : at + hi - lo] << 8]
            else:
                total ^= tables[k // 2].take(pair[at : at + hi - lo])
    return out


def cut_points(data: bytes, options: RabinOptions = RabinOptions()) -> list[tuple[int, str]]:  # noqa: B008
    """(end, reason) of each chunk: 'content', 'max' or 'close'."""
    array, n = np.frombuffer(data, np.uint8), len(data)
    mask, w = options.average - 1, options.window
    found = np.flatnonzero(window_hashes(array, options) & np.uint16(mask) == np.uint16(mask)) + w - 1
    append = append_table(options.polynomial)
    out, start = [], 0
    while start < n:
        first, stop = start + options.least - w, min(n, start + options.most)
        value, end = 0, None
        for k in range(first, min(first + w - 1, stop)):  # the window is not full yet
            value = ((value << 8 | data[k]) & (2**64 - 1)) ^ append[value >> 55]
            if value & mask == mask:
                end = k + 1
                break
        if end is None:
            k = np.searchsorted(found, first + w - 1)
            if k < len(found) and found[k] < stop:
                end = int(found[k]) + 1
        reason = "content"
        if end is None:
            end, reason = stop, "max" if stop - start == options.most else "close"
        out.append((end, reason))
        start = end
    return out
