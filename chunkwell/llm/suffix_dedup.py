"""Removal of repeated passages: every byte that a 100-byte string covers which also starts earlier.

Suffixes of a whole corpus cannot be sorted in one place, so the windows (100-byte strings, one per start) are
dealt by a key that only their content decides: the least hash among the 61 40-grams of a window. Equal windows
have equal keys. Neighbouring windows mostly share their key, so what travels are runs of windows, not windows.

1. Documents are dealt into batches of some MB, by id and text; later steps read the same exchange. Texts below 100 bytes have no window and go nowhere.
2. A batch lists the keys of its windows (once each, twice if it has the key in several runs). Buckets of keys find those
   that occur more than once; only runs with such a key go on. Each batch is told its own.
   A key of very many runs is hot: of its windows, batches also list the hashes of all 100 bytes, and buckets of these
   find the ones that occur more than once. Its runs are cut down to those windows.
3. A batch sends each distinct run (its bytes, document and start) to the bucket of its key. A run whose bytes the batch
   has sent already is marked at once: the earlier one is in the same batch. Its mark goes to a bucket that the batch's number names, not the key.
4. A bucket sorts the suffixes of its runs in two stages: those smaller than their successor are sorted directly,
   on eight bytes at a time; the larger ones are induced by a scan over the buckets of first bytes. Adjacent common prefixes
   of 100 bytes join equal windows; all but the earliest are marked. Runs of hot keys go by way of groups of GROUP batches: each group marks all but its own
   earliest windows and passes on only these, so that a key's bucket gets one run for each group, not for each batch.
5. Marks return to their batch, where covered bytes are counted and the rest is hashed.

All of it is one query, so the documents are shuffled once and all steps read that exchange; were it cut in two, each half would shuffle them, and the first one's shuffle files
might be there still.

A window's content is sent once per batch at most, however often it occurs, so a passage in a third of all documents loads no task.
Without the cut, the windows over its ends, or over a frequent phrase below 100 bytes, would
send another run for each document, as each has other bytes beside it. Batches and buckets grow in number, not in size; a long
text is gone through in slices of CHUNK windows.

Nulls and edge cases: a null text is empty; a null id sorts first; rows that share an id (or have none) count as following each other in the
order of a hash of their texts, so a repeated row is removed whole if it has 100 bytes, and rows without an id load no task; texts below 100 bytes lose nothing; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

LENGTH = 100
GRAM = 40
CHUNK = 1 << 18
BATCH_MB = 8
HOT = 4096  # runs that one key may send to its bucket unexamined: about 1 MB
GROUP = 4096  # batches whose runs of a hot key are compared with each other before the rest
U64 = np.uint64
NO_ID = -(2**63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_BYTES = _mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_STEPS = _mix(np.arange(1, 9, dtype=U64)) | U64(1)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all 40-grams, by doubling: 1, 2, 4, ... 32 bytes, then 32 and 8."""
    h, size, eight = _BYTES[b], 1, None
    for k in range(5):
        if size == 8:
            eight = h
        h = h[:-size] * _STEPS[k] + h[size:]
        size *= 2
    n = len(b) - GRAM + 1
    return _mix(h[:n] * _STEPS[6] + eight[32 : 32 + n])


def _window_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all 100-byte windows, by doubling: 1, 2, 4, ... 64 bytes, then 64, 32 and 4."""
    h, held = _BYTES[b], {}
    for k in range(6):
        held[1 << k] = h
        h = h[: -(1 << k)] * _STEPS[k] + h[1 << k :]
    n = len(b) - LENGTH + 1
    return _mix((h[:n] * _STEPS[6] + held[32][64 : 64 + n]) * _STEPS[7] + held[4][96 : 96 + n])


def _within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _spread_out(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, number of its run) of every window of the runs."""
    run = np.repeat(np.arange(len(first)), count)
    return first[run] + np.arange(len(run)) - (np.cumsum(count) - count)[run], run


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def _own_repeats(h: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Keys of runs that have their key's gram twice: windows of one such run may be equal."""
    padded = np.r_[np.zeros(width - 1, U64), low, np.zeros(width - 1, U64)]
    size = 1
    while size * 2 <= width:
        padded = np.maximum(padded[:-size], padded[size:])
        size *= 2
    most = np.maximum(padded[: len(padded) - (width - size)], padded[width - size :])
    at = np.flatnonzero(most == h)  # grams that are the least of some window
    twice = (h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] <= width)
    return h[at[1:][twice]]


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(first text, bytes, where each text begins in them, where each ends): several texts at a time, or CHUNK windows of a long one, which then begins before the slice."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > CHUNK:
            for lo in range(0, len(texts[at]) - length + 1, CHUNK):
                piece = texts[at][lo : lo + CHUNK + length - 1]
                yield at, piece, np.array([-lo]), np.array([len(piece)])
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        sizes = np.array([len(t) for t in texts[at:end]])
        yield at, b"".join(texts[at:end]), np.cumsum(sizes) - sizes, np.cumsum(sizes)
        at = end


def runs(texts: list[bytes], length: int = LENGTH, own: list[np.ndarray] | None = None) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows that share a key, some texts at a time.

    Yields (first text, bytes of these texts, where each begins there, run starts there, run lengths in windows, keys).
    ``own`` gets the keys of runs that may repeat a window themselves.
    """
    for at, joined, begins, ends in _slices(texts, length):
        if len(joined) >= length:
            h = _gram_hashes(np.frombuffer(joined, np.uint8))
            low = _sliding_min(h, length - GRAM + 1)
            if own is not None:
                own.append(_own_repeats(h, low, length - GRAM + 1))
            valid = np.ones(len(low) + 1, bool)
            for e in ends.tolist():  # windows that begin in the last bytes of a text would leave it
                valid[max(0, e - length + 1) : e] = False
            valid[-1] = False
            new = np.empty(len(low) + 1, bool)
            new[0] = True
            new[-1] = True
            new[1:-1] = low[1:] != low[:-1]
            new[1:] |= valid[1:] != valid[:-1]
            edges = np.flatnonzero(new)
            first = edges[:-1]
            keep = valid[first]
            first, count = first[keep], np.diff(edges)[keep]
            yield at, joined, begins, first, count, low[first]


# Two-stage suffix sorting


def suffix_order(text: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The positions ``used`` of a text in the order of their suffixes, down to 104 bytes.

    ``text`` holds bytes plus one, and 0 after each run, where suffixes end. ``used`` must be closed: with a position whose
    suffix is larger than its successor's it has that successor.
    """
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    after = np.searchsorted(change, np.arange(n - 1))
    rises = np.r_[text[1:][change] > text[change], False]
    smaller = np.r_[rises[np.minimum(after, len(rises) - 1)], True]  # than the successor; so are ends
    smaller[text == 0] = True

    # First stage: suffixes smaller than their successors, on eight bytes at a time; groups of equals are refined.
    direct = used[smaller[used]]
    plain = np.where(text > 0, text - 1, 0).astype(np.uint64)
    padded = np.r_[plain, np.zeros(LENGTH + 12, U64)]
    word = np.zeros(n + LENGTH + 4, U64)
    for k in range(8):
        word |= padded[k : k + len(word)] << U64(56 - 8 * k)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, direct)] - direct  # bytes before the end; behind it counts as zeros
    value = word[direct] & _top(left)
    order = np.lexsort((value, text[direct]))
    direct, left, value = direct[order], left[order], value[order]
    head = text[direct]
    new = np.ones(len(direct), bool)
    new[1:] = (value[1:] != value[:-1]) | (head[1:] != head[:-1])
    for depth in range(8, LENGTH, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group, sub, rest = np.cumsum(new)[at], direct[at], left[at]
        value = word[np.minimum(sub + depth, n)] & _top(rest - depth)
        order = np.lexsort((value, group))
        direct[at], left[at], value = sub[order], rest[order], value[order]
        new[at[1:]] |= (group[1:] == group[:-1]) & (value[1:] != value[:-1])

    # Second stage: a scan over the buckets of first bytes induces the larger suffixes, in order.
    wanted = np.zeros(n + 1, bool)
    wanted[used] = True
    larger = wanted[:n] & ~smaller
    starts = np.searchsorted(text[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        mine = waiting[c]
        front = np.concatenate(mine) if mine else np.empty(0, np.int64)
        done = [front]
        while len(front):  # larger suffixes that begin with the same byte once more
            before = front - 1
            before = before[(before >= 0)]
            front = before[larger[before] & (text[before] == c)]
            done.append(front)
        bucket = np.concatenate([*done, direct[starts[c] : starts[c + 1]]])
        if len(bucket):
            out.append(bucket)
            before = bucket - 1
            before = before[before >= 0]
            before = before[larger[before] & (text[before] > c)]
            if len(before):
                firsts = text[before]
                by = np.argsort(firsts, kind="stable")
                before, firsts = before[by], firsts[by]
                cuts = np.flatnonzero(np.r_[True, firsts[1:] != firsts[:-1]])
                for x, y in zip(cuts, np.r_[cuts[1:], len(firsts)], strict=True):
                    waiting[firsts[x]].append(before[x:y])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _top(n: np.ndarray) -> np.ndarray:
    """Masks of the first n bytes of a word, n up to 8."""
    bits = np.clip(n, 0, 8).astype(np.uint64) * U64(8)
    return np.where(bits == 0, U64(0), ~U64(0) << (U64(64) - np.maximum(bits, U64(1))))


def repeated_windows(pieces: list[bytes], counts: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each run (its bytes, its number of windows): which of its windows also start earlier.

    ``rank`` orders the runs' first windows; windows of one run follow each other, and runs do not interleave.
    """
    sizes = np.array([len(p) for p in pieces])
    starts = np.r_[0, np.cumsum(sizes + 1)]
    text = np.zeros(starts[-1], np.int16)
    body = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text[:] = body.astype(np.int16) + 1
    text[starts[1:] - 1] = 0
    n = len(text)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    offset = np.arange(n) - starts[piece]
    window = offset < counts[piece]
    # Behind its last window a run keeps positions up to the first suffix that is smaller than its successor.
    change = np.flatnonzero(text[1:] != text[:-1])
    after = np.searchsorted(change, np.arange(n - 1))
    rises = np.r_[text[1:][change] > text[change], False]
    smaller = np.r_[rises[np.minimum(after, len(rises) - 1)], True]
    smaller[text == 0] = True
    stops = np.flatnonzero(smaller)
    last = stops[np.searchsorted(stops, starts[:-1] + counts)]
    used = np.flatnonzero(window | (np.arange(n) <= last[piece]))
    order = suffix_order(text, used)
    order = order[window[order]]
    # Adjacent common prefixes, eight bytes at a time, as far as 100 bytes.
    padded = np.r_[body, np.zeros(16, np.uint8)].astype(np.uint64)
    word = np.zeros(n, U64)
    for k in range(8):
        word |= padded[k : k + n] << U64(56 - 8 * k)
    equal = np.ones(max(0, len(order) - 1), bool)
    for depth in [*range(0, length - 8, 8), length - 8]:
        at = np.flatnonzero(equal)
        if not len(at):
            break
        equal[at] = word[order[at] + depth] == word[order[at + 1] + depth]
    group = np.r_[0, np.cumsum(~equal)] if len(order) else np.empty(0, np.int64)
    place = rank[piece[order]] * (int(sizes.max(initial=0)) + 1) + offset[order]
    by = np.lexsort((place, group))
    first = np.r_[True, group[by][1:] != group[by][:-1]] if len(by) else np.empty(0, bool)
    marked = np.zeros(n, bool)
    marked[order[by[~first]]] = True
    return [marked[s : s + c] for s, c in zip(starts[:-1].tolist(), counts.tolist(), strict=True)]


# Spark


class Batch:
    """The documents of a batch in order: names (id, hash of the text, number among equal rows) and texts as bytes. Rows of one id and text are always in one batch."""

    def __init__(self, table: pa.Table):
        ids = [NO_ID if x is None else x for x in table.column("doc_id").to_pylist()]
        texts = [t.encode() for t in table.column("text").to_pylist()]
        rows = sorted(zip(ids, [xxhash.xxh64_intdigest(t) - 2**63 for t in texts], texts, strict=True))
        self.texts = [t for *_, t in rows]
        self.names: list[tuple[int, int, int]] = []
        for k, (i, h, t) in enumerate(rows):
            same = k and rows[k - 1] == (i, h, t)
            self.names.append((i, h, self.names[-1][2] + 1 if same else 0))


#: Numbers of a place: a document's name, where a run begins in it, and its windows.
PLACE = 5


LISTED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
KNOWN = pa.schema([("batch", pa.int64()), ("keys", pa.binary()), ("hot", pa.binary())])


def _listed(batch: int, keys: np.ndarray, buckets: int) -> pa.Table:
    """A batch's distinct keys and their counts, by bucket."""
    keys, counts = np.unique(keys, return_counts=True)
    bucket = (keys % U64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[by], np.minimum(counts[by], 2**32 - 1).astype(np.uint32), bucket[by]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(keys)] if len(keys) else cuts
    blobs = [[x[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)] for x in (keys, counts)]
    return pa.Table.from_arrays([pa.array(bucket[cuts], pa.int64()), pa.array([batch] * len(cuts), pa.int64()), *[pa.array(x, pa.binary()) for x in blobs]], schema=LISTED)


def _keys(table: pa.Table, buckets: int) -> pa.Table:
    """The keys of a batch's runs; a run that may repeat a window itself counts twice."""
    own: list[np.ndarray] = []
    found = [np.empty(0, U64), *[keys for *_, keys in runs(Batch(table).texts, own=own)]]
    return _listed(table.column("batch")[0].as_py(), np.concatenate(found + own), buckets)


def _repeated(table: pa.Table, hot: int) -> pa.Table:
    """(batch, keys, hot): of a bucket's keys those that occur more than once, for each batch that has them, and whether more than ``hot`` times."""
    lists = [np.frombuffer(x.as_py(), U64) for x in table.column("keys")]
    keys = np.concatenate(lists)
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")]).astype(np.int64)
    owner = np.repeat(np.array(table.column("batch").to_pylist()), [len(x) for x in lists])
    by = np.argsort(keys, kind="stable")
    keys, owner, counts = keys[by], owner[by], counts[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    total = np.repeat(np.add.reduceat(counts, first), np.diff(np.r_[first, len(keys)]))
    many = total > 1
    keys, owner, often = keys[many], owner[many], (total[many] > hot).astype(np.uint8)
    by = np.argsort(owner, kind="stable")
    keys, owner, often = keys[by], owner[by], often[by]
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(keys) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(keys)] if len(keys) else cuts
    blobs = [[x[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)] for x in (keys, often)]
    return pa.Table.from_arrays([pa.array(owner[cuts], pa.int64()), *[pa.array(x, pa.binary()) for x in blobs]], schema=KNOWN)


def _joined(known: pa.Table, name: str, kind=U64) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[np.frombuffer(x.as_py(), kind) for x in known.column(name) if x.is_valid]])


def _hot_keys(known: pa.Table) -> np.ndarray:
    return np.sort(_joined(known, "keys")[_joined(known, "hot", np.uint8) > 0])


def _hot_windows(docs: pa.Table, known: pa.Table, buckets: int) -> pa.Table:
    """Hashes of the windows whose key is hot."""
    hot = _hot_keys(known)
    if not len(docs) or not len(hot):
        return LISTED.empty_table()
    found = [np.empty(0, U64)]
    for _, joined, _, first, count, keys in runs(Batch(docs).texts):
        hit = _within(keys, hot)
        if hit.any():
            found.append(_window_hashes(np.frombuffer(joined, np.uint8))[_spread_out(first[hit], count[hit])[0]])
    return _listed(docs.column("batch")[0].as_py(), np.concatenate(found), buckets)


def _cut_down(joined: bytes, first: np.ndarray, count: np.ndarray, keys: np.ndarray, hot: np.ndarray, again: np.ndarray):
    """The runs in order, those of hot keys without windows that occur once."""
    hit = _within(keys, hot)
    if not hit.any():
        return first, count, keys
    at, run = _spread_out(first[hit], count[hit])
    stays = _within(_window_hashes(np.frombuffer(joined, np.uint8))[at], again)
    begins = stays & np.r_[True, ~stays[:-1] | (run[1:] != run[:-1])]
    sizes = np.bincount(np.cumsum(begins)[stays] - 1, minlength=int(begins.sum())).astype(count.dtype)
    first, count, keys = np.r_[first[~hit], at[begins]], np.r_[count[~hit], sizes], np.r_[keys[~hit], keys[hit][run[begins]]]
    by = np.argsort(first, kind="stable")
    return first[by], count[by], keys[by]


PIECES = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("batch", pa.int64()), ("places", pa.binary()), ("repeats", pa.binary()), ("bytes", pa.binary())])
SENT = "bucket long, part long, batch long, places binary, repeats binary, bytes binary"
WHOLE = -1  # the part of runs that go to their key's bucket at once


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _packed(numbers) -> bytes:
    return np.array(numbers, np.int64).tobytes()


def _pieces(docs: pa.Table, known: pa.Table, buckets: int, group: int) -> pa.Table:
    """Runs with a repeated key, by bucket and part: places and bytes of the distinct ones; and the places of the others, which are marks already."""
    if not len(docs) or not len(known):
        return PIECES.empty_table()
    batch, number = Batch(docs), docs.column("batch")[0].as_py()
    repeated, hot, again = np.sort(_joined(known, "keys")), _hot_keys(known), np.sort(_joined(known, "windows"))
    sent: set[bytes] = set()
    out: dict[tuple[int, int], tuple[list, list]] = {}
    repeats: list[int] = []
    for at, joined, begins, first, count, keys in runs(batch.texts):
        hit = _within(keys, repeated)
        first, count, keys = _cut_down(joined, first[hit], count[hit], keys[hit], hot, again)
        bucket = (keys % U64(buckets)).astype(np.int64)
        part = np.where(_within(keys, hot), number // group, WHOLE)
        doc = np.searchsorted(begins, first, side="right") - 1
        rows = zip(first.tolist(), count.tolist(), bucket.tolist(), part.tolist(), (doc + at).tolist(), (first - begins[doc]).tolist(), strict=True)
        for x, n, b, p, d, start in rows:
            piece = joined[x : x + n + LENGTH - 1]
            if piece in sent:
                repeats += (*batch.names[d], start, n)
            else:
                sent.add(piece)
                places, bodies = out.setdefault((b, p), ([], []))
                places += (*batch.names[d], start, n)
                bodies.append(piece)
    rows = [(b, p, number, _packed(places), b"", b"".join(bodies)) for (b, p), (places, bodies) in out.items()]
    if repeats:
        rows.append((number % buckets, WHOLE, number, b"", _packed(repeats), b""))
    return _table(rows, PIECES)


FOUND = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("marks", pa.binary()), ("places", pa.binary()), ("bytes", pa.binary())])


def _found(table: pa.Table, buckets: int, last: bool = False) -> pa.Table:
    """Of the runs of a bucket, or of a part of one: marks (places of windows that also start earlier) by batch, in a bucket that the batch's number names, and,
    unless this is the ``last`` word, the runs of windows that are the earliest here.
    """
    bucket, passed = table.column("bucket")[0].as_py(), not last and table.column("part")[0].as_py() != WHOLE
    marks: dict[int, list[int]] = {}
    first: dict[bytes, tuple[tuple[int, ...], int]] = {}
    for batch, places, repeats, body in zip(*(table.column(c) for c in ("batch", "places", "repeats", "bytes")), strict=True):
        batch, body, at = batch.as_py(), body.as_py(), 0
        mine = marks.setdefault(batch, [])
        mine += np.frombuffer(repeats.as_py(), np.int64).tolist()
        for place in map(tuple, np.frombuffer(places.as_py(), np.int64).reshape(-1, PLACE).tolist()):
            end = at + place[-1] + LENGTH - 1
            piece = body[at:end]
            at = end
            held = first.get(piece)
            if held is None:
                first[piece] = (place, batch)
            elif place < held[0]:
                first[piece] = (place, batch)
                marks.setdefault(held[1], []).extend(held[0])
            else:
                mine += place
    on: dict[int, tuple[list[int], list[bytes]]] = {}
    if first:
        pieces = list(first)
        where = [first[p][0] for p in pieces]
        rank = np.empty(len(pieces), np.int64)
        rank[sorted(range(len(pieces)), key=where.__getitem__)] = np.arange(len(pieces))
        found = repeated_windows(pieces, np.array([p[-1] for p in where]), rank)
        for piece, place, hit in zip(pieces, where, found, strict=True):
            *name, start, _ = place
            batch = first[piece][1]
            for x, y in _stretches(hit):
                marks.setdefault(batch, []).extend((*name, start + x, y - x))
            if passed:
                places, bodies = on.setdefault(batch, ([], []))
                for x, y in _stretches(~hit):
                    places += (*name, start + x, y - x)
                    bodies.append(piece[x : y + LENGTH - 1])
    rows = [(b % buckets, b, _packed(m), b"", b"") for b, m in marks.items() if m]
    return _table(rows + [(bucket, b, b"", _packed(p), b"".join(t)) for b, (p, t) in on.items() if p], FOUND)


MARKS = pa.schema([("batch", pa.int64()), ("marks", pa.binary())])


def _settled(table: pa.Table, buckets: int) -> pa.Table:
    """All marks: those that are known, and those among the runs that the parts of a bucket have passed on."""
    known = table.filter(pc.greater(pc.binary_length(table.column("marks")), 0)).select(MARKS.names).cast(MARKS)
    on = table.filter(pc.greater(pc.binary_length(table.column("places")), 0))
    if not len(on):
        return known
    none, whole = pa.array([b""] * len(on), pa.binary()), pa.array([WHOLE] * len(on), pa.int64())
    sent = pa.Table.from_arrays([on.column("bucket"), whole, on.column("batch"), on.column("places"), none, on.column("bytes")], names=PIECES.names)
    return pa.concat_tables([known, _found(sent, buckets, True).select(MARKS.names)])


def _stretches(hit: np.ndarray) -> list[list[int]]:
    return np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).reshape(-1, 2).tolist() if hit.any() else []


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _removed(docs: pa.Table, marked: pa.Table, with_text: bool) -> pa.Table:
    """Per document what is left once the bytes under marked windows are gone."""
    spans: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for blob in marked.column("marks"):
        for *name, start, n in np.frombuffer(blob.as_py(), np.int64).reshape(-1, PLACE).tolist():
            spans.setdefault(tuple(name), []).append((start, start + n + LENGTH - 1))
    batch, rows = Batch(docs), []
    for name, text in zip(batch.names, batch.texts, strict=True):
        kept, at, removed, n = [], 0, 0, 0
        for a, b in sorted(spans.get(name, ())):
            if not n or a > at:
                n += 1
                kept.append(text[at:a])
                removed += b - a
                at = b
            elif b > at:
                removed += b - at
                at = b
        kept.append(text[at:])
        left = b"".join(kept)
        rows.append((None if name[0] == NO_ID else name[0], len(text), removed, n, hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
    schema = RESULT.append(pa.field("kept", pa.binary())) if with_text else RESULT
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def remove_repeats(docs: DataFrame, with_text: bool = False, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; and ``kept``, the bytes that stay, if asked for. ``hot`` and ``group`` change the way, not the result."""
    batches = parts(docs, BATCH_MB)
    buckets = 4 * batches
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = F.octet_length("text") < LENGTH
    dealt = rows.where(~short).withColumn("batch", F.expr(f"pmod(xxhash64(doc_id, text), {batches}L)")).repartition(batches, "batch")
    listed, told = "bucket long, batch long, keys binary, counts binary", "batch long, keys binary, hot binary"
    keys = dealt.groupBy("batch").applyInArrow(lambda t: _keys(t, batches), listed)
    known = keys.groupBy("bucket").applyInArrow(lambda t: _repeated(t, hot), told)
    windows = dealt.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(lambda d, k: _hot_windows(d, k, batches), listed)
    again = windows.groupBy("bucket").applyInArrow(lambda t: _repeated(t, hot), told).select("batch", F.col("keys").alias("windows"))
    both = known.unionByName(again, allowMissingColumns=True)
    pieces = dealt.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(lambda d, k: _pieces(d, k, buckets, group), SENT)
    found = "bucket long, batch long, marks binary, places binary, bytes binary"
    by_part = pieces.groupBy("bucket", "part").applyInArrow(lambda t: _found(t, buckets), found)
    marks = by_part.groupBy("bucket").applyInArrow(lambda t: _settled(t, buckets), "batch long, marks binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    cut = dealt.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(lambda d, m: _removed(d, m, with_text), schema)
    raw, none = F.encode("text", "UTF-8"), F.lit(0).cast("long")
    whole = rows.where(short).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), *([raw.alias("kept")] if with_text else []))
    return cut.unionByName(whole)
