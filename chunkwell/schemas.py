"""Fixed numbers of the data model."""

from __future__ import annotations


# Sizes, sentinels and shifts of the stored formats.
BLOCK_SIZE = 256 * 1024
MAX_CHUNK = 65536
VOLUME_BITS = 16
BLOCK_SHIFT = 63 - VOLUME_BITS
EMPTY_FP = "02"  # hex of the single byte that stands for an empty chunk
EMPTY_ADDRESS, ILLEGAL_ADDRESS = -2, -1
CONTAINER_SIZE = 4 * 1024 * 1024
CONTAINER_META = 124 * 1024
ITEM_META = 84
