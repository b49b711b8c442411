"""Packing of tokenised documents into training sequences, balanced by attention cost.

A document's ids are cut at multiples of the sequence length; full pieces are sequences
of their own. The rest of each document waits in a pool. A pool of a few dozen
sequences is filled at once: its pieces, in descending order of estimated cost
(``a * length + b * length^2``), each go to the sequence of lowest cost that still has
room for them; a piece that fits nowhere is cut to fill the largest gap, then the next one. Each pool opens
only as many sequences as it can fill, what is left over goes to the next pool, and the
last tokens of a partition become sequences whose lengths are powers of two, which
need no padding, filled by the same rule. So no token of padding is spent.

One pass over the documents, without a shuffle: a task holds one pool besides its batch.
Sequence ids carry the partition's number, so they are unique without coordination, and
a task that runs again gives the same rows for the same input split.

Nulls and edge cases: a null text is empty and has the end id only; ids may be null or
repeated, each row is a document; an empty table gives no rows; texts of any length are
encoded whole; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
POOL = 64
END = 1
#: The pre-tokeniser pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(path: str):
    """text -> ids of a byte-level BPE in the format of ``tokenizers``, merged by tiktoken, which is four times as fast.

    Such files spell bytes as printable characters: those that print stand for themselves, the others, in order, for 256 and up.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if all(c in byte_of for c in piece) and not (piece.startswith("<|") and piece.endswith("|>"))}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def added_encoder(path: str):
    """text -> ids as ``tokenizers`` gives them: the file's added tokens are found in the text first, and what lies between them is merged.

    Of tokens that begin at one place the longest is taken. Tokens with options that change where they match are refused.
    """
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t for t in json.load(f).get("added_tokens") or []}
    if odd := [c for c, t in added.items() if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]:
        raise ValueError(f"added tokens that match by other rules: {odd}")
    plain = encoder(path)
    if not added:
        return plain
    parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split

    def encode(text: str) -> list[int]:
        found = parts(text)
        if len(found) == 1:
            return plain(text)
        ids: list[int] = []
        for k, part in enumerate(found):  # every other part is a token
            if k % 2:
                ids.append(added[part]["id"])
            elif part:
                ids += plain(part)
        return ids

    return encode


def cost(length: float, a: float = 1.0, b: float = 1.0 / LENGTH) -> float:
    """Estimated work of a piece: linear for the layers, quadratic for attention."""
    return a * length + b * length * length


def fill(pieces: list[tuple[int, int, int]], rooms: list[int]) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Assign (document, start, length) pieces to sequences of the given rooms, all filled to the end; what is left over comes second.

    The pieces must hold ``sum(rooms)`` tokens or more. Costs are compared by the token of a sequence's room.
    """
    room, work = list(rooms), [0.0] * len(rooms)
    seqs: list[list[tuple[int, int, int]]] = [[] for _ in rooms]

    def put(k: int, piece: tuple[int, int, int]) -> None:
        seqs[k].append(piece)
        room[k] -= piece[2]
        work[k] += cost(piece[2]) / rooms[k]

    late = []
    for p in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        k = min((k for k, free in enumerate(room) if free >= p[2]), key=lambda k: (work[k], k), default=None)
        if k is None:
            late.append(p)
        else:
            put(k, p)
    left = []
    for doc, start, size in late:
        while size and any(room):
            k = max(range(len(room)), key=lambda k: (room[k], -k))
            part = min(room[k], size)
            put(k, (doc, start, part))
            start, size = start + part, size - part
        if size:
            left.append((doc, start, size))
    return seqs, left


def _packed(batches: Iterator[pa.RecordBatch], path: str, length: int, pool: int) -> Iterator[pa.RecordBatch]:
    encode, task = added_encoder(path), TaskContext.get().partitionId()
    docs: dict[int, tuple[int | None, np.ndarray]] = {}
    waiting: list[tuple[int, int, int]] = []
    number = held = sequence = 0
    out: list[tuple] = []

    def emit(pieces) -> None:
        nonlocal sequence
        offset = 0
        for key, start, size in pieces:
            doc_id, ids = docs[key]
            out.append((doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), (task << 40) | sequence, offset))
            offset += size
        sequence += 1

    def settle(full: bool) -> None:
        """Pack what waits: all of it if ``full``, else as many sequences as it fills."""
        nonlocal waiting, held
        if n := held // length:
            seqs, waiting = fill(waiting, [length] * n)
            for pieces in seqs:
                emit(pieces)
            held -= n * length
        if full and held:
            for pieces in fill(waiting, [1 << bit for bit in reversed(range(held.bit_length())) if held >> bit & 1])[0]:
                emit(pieces)
            waiting, held = [], 0
        alive = {p[0] for p in waiting}
        for key in [k for k in docs if k not in alive]:
            del docs[key]

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        out.clear()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
            docs[number] = (doc_id, ids)
            whole = len(ids) - len(ids) % length
            for start in range(0, whole, length):
                emit([(number, start, length)])
            if len(ids) > whole:
                waiting.append((number, whole, len(ids) - whole))
                held += len(ids) - whole
            else:
                del docs[number]
            number += 1
            if held >= pool * length:
                settle(False)
        yield rows()
    settle(True)
    yield rows()


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, pool: int = POOL) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(lambda batches: _packed(batches, tokenizer, length, pool), SCHEMA)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
