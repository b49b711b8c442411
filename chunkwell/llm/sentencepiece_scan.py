"""SentencePiece encoding and decoding by a max-plus scan, giant documents in parallel.

A segmentation is a path through a lattice whose states are the last piece so far. For a unigram model a step weighs
the score of the next piece. For a byte-pair model a step weighs 0 where the two pieces stay apart when
they are merged on their own, and minus infinity where they do not; the merge result is the one path
of weight 0, as a sequence of pieces is a merge result if each neighbouring pair is. In either case
a stretch of text is a max-plus matrix from the states at its front to those at its back.

Texts up to ``chunk`` characters are one stretch. Longer ones are cut at any character. Each chunk, with a halo of one piece's length,
gives its transfer matrix between the pieces that can lie across its two cuts;
products of these matrices, combined pairwise in any grouping, say which piece lies across each cut on
the best path; then every chunk is traced back alone between its two pieces. Matrices (some dozen states squared per chunk) are multiplied by a
tree over the cluster: FAN neighbours give one matrix, FAN of these the next, up to the document's, and the states at
the cuts come down the same way. So no task ever has more than FAN matrices of a document; chunks of text go to tasks on their own.

Between words all states collapse into one: no piece of the vocabulary goes on into a new word. Stretches inside a word are the
only ones with matrices of more than one entry, and the words themselves are kept with their ids.

Nulls and edge cases: a null text is empty and has no ids; ids may be null or repeated, rows are told apart by
position; characters the vocabulary lacks become their bytes; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK = 1 << 16
FAN = 32
KEPT_WORDS = 500_000
SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NEVER = float("-inf")
BYTE_PAIR, UNIGRAM = "bpe", "unigram"

#: A state at a cut: (where the piece across the cut or up to it begins, its length, its id). Places count from the cut.
State = tuple[int, int, int]
START: State = (0, 0, -1)


class _Words(dict):
    """Ids of words, as bytes of 32-bit numbers, kept; emptied when there are KEPT_WORDS."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = array("i", self.vocabulary.word(word)).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Vocabulary:
    """Pieces of a model file, and the lattice steps between them."""

    def __init__(self, path: str, kind: str = BYTE_PAIR):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind
        n = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = [self.model.get_score(i) for i in range(n)]
        self.byte_ids = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids) if self.model.is_byte(i)}
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte_of)] = True
        self.unknown = self.model.unk_id()
        self.longest = max(map(len, self.ids))
        self.joints: dict[int, float] = {}
        self.words = _Words(self)
        self.reach: dict[str, tuple[int, ...]] = {}
        self.units = self.pattern()
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on into a new word; words cannot be cut apart")
        if kind == BYTE_PAIR:  # pieces that no merges make never occur in a result
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}
        sizes: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                sizes.setdefault(p[:3], set()).add(len(p))
        self.long = {k: tuple(sorted(n, reverse=True)) for k, n in sizes.items()}

    def pattern(self) -> re.Pattern:
        """Units that no piece goes across: words with the space marks before them, and what stands behind a letter that
        no piece has there (mostly punctuation). Units come from the vocabulary's own pieces."""
        behind = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        apart = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in behind and c != "_")
        line = "\n" if not any("\n" in p for p in self.ids) else ""
        if not apart:
            return WORD
        inner = f"(?:[^{SPACE}{apart}{line}]|(?<![^\\W\\d_])[{apart}])"
        return re.compile(f"{SPACE}*{inner}+|[{apart}]{inner}*|{SPACE}+" + (f"|{line}" if line else ""))

    def merged(self, text: str) -> list[str]:
        """Greedy merging of the best pair, leftmost first: for the short texts that joints are made of, and runs of spaces of any length."""
        if len(text) > 48:
            return self.merged_by_heap(text)
        parts, ids, score = list(text), self.ids, self.score
        ranks = [NEVER if (i := ids.get(x + y)) is None else score[i] for x, y in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = max(ranks)
            if best == NEVER:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = NEVER if (i := ids.get(parts[k] + parts[k + 1])) is None else score[i]
            if k:
                ranks[k - 1] = NEVER if (i := ids.get(parts[k - 1] + parts[k])) is None else score[i]
        return parts

    def merged_by_heap(self, text: str) -> list[str]:
        """The same in n log n steps: pairs wait in a heap by score and place, and one whose parts have changed since is passed over."""
        n, ids, score = len(text), self.ids, self.score
        part: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n and (i := ids.get(part[k] + part[after[k]])) is not None:
                heappush(heap, (-score[i], k, part[k], part[after[k]]))

        for k in range(n):
            offer(k)
        while heap:
            _, k, x, y = heappop(heap)
            j = after[k]
            if part[k] != x or j >= n or part[j] != y:
                continue
            part[k], part[j], after[k] = x + y, None, after[j]
            if after[k] < n:
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return [p for p in part if p is not None]

    def step(self, a: int, a_text: str, b: int, b_text: str) -> float:
        """Weight of piece b after piece a (-1: nothing before)."""
        if self.kind == UNIGRAM:
            return self.score[b] if b != self.unknown else min(self.score) - 10
        if a < 0 or a == self.unknown or b == self.unknown:
            return 0.0
        key = a << 32 | b
        got = self.joints.get(key)
        if got is None:
            got = 0.0 if self.merged(a_text + b_text) == [a_text, b_text] else NEVER
            if len(self.joints) > 500_000:
                self.joints.clear()
            self.joints[key] = got
        return got

    def lengths(self, text: str, at: int) -> tuple[int, ...]:
        """Lengths, longest first, that pieces at a place can have, by the three characters there."""
        key = text[at : at + 3]
        got = self.reach.get(key)
        if got is None:
            if len(self.reach) > 200_000:
                self.reach.clear()
            got = self.reach[key] = (*self.long.get(key, ()), *((2,) if len(key) > 1 and key[:2] in self.ids else ()), 1)
        return got

    def starting(self, text: str, at: int) -> list[tuple[int, int]]:
        """(length, id) of the pieces that begin at a place; an unknown character is a piece of its own."""
        ids, unknown = self.ids, self.unknown
        return [(n, i) for n in self.lengths(text, at) if at + n <= len(text) and (i := ids.get(text[at : at + n], unknown if n == 1 else None)) is not None]

    def covering(self, text: str, cut: int) -> list[State]:
        """States at a cut: pieces that hold the character before it."""
        out = []
        for at in range(max(0, cut - self.longest), cut):
            out += [(at - cut, n, i) for n, i in self.starting(text, at) if at + n >= cut]
        return out

    def forward(self, text: str, lo: int, hi: int, entries: list[State], cut: int) -> dict[tuple[int, int], dict[int, float]]:
        """Weights, from each entry state, of being at a place with a last piece: {(end, id): {entry: weight}}.

        ``lo`` is the cut of the entries; pieces that begin at ``hi`` or later are not taken.
        """
        at: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        for k, (start, n, i) in enumerate(entries):
            w = np.full(len(entries), NEVER)
            w[k] = 0.0
            cell = at.setdefault(lo + start + n, {})
            cell[i, n] = np.maximum(cell[i, n], w) if (i, n) in cell else w
        done: dict[tuple[int, int, int], np.ndarray] = {}
        for place in range(lo, hi):
            here = at.pop(place, None)
            if not here:
                continue
            for n, i in self.starting(text, place):
                best = None
                for (j, m), w in here.items():
                    s = self.step(j, text[place - m : place] if j >= 0 else "", i, text[place : place + n])
                    if s > NEVER:
                        best = w + s if best is None else np.maximum(best, w + s)
                if best is None:
                    continue
                if place + n >= hi:
                    key = (place, n, i)
                    done[key] = best
                cell = at.setdefault(place + n, {})
                cell[i, n] = np.maximum(cell[i, n], best) if (i, n) in cell else best
        for place, cell in at.items():  # entries that reach beyond the stretch
            for (i, n), w in cell.items():
                if place >= hi and (place - n, n, i) not in done and place - n < lo:
                    done[place - n, n, i] = w
        return done

    def matrix(self, text: str, lo: int, hi: int, entries: list[State], exits: list[State]) -> np.ndarray:
        """Max-plus transfer from the states at cut ``lo`` to those at cut ``hi``. Whole words in between are skipped for
        a byte-pair model, where they weigh nothing, and add their best score for a unigram one."""
        first, last = self.edges(text, lo, hi)
        if first is None:
            return self.select(self.forward(text, lo, hi, entries, hi), hi, exits)
        front = self.forward(text, lo, first, entries, first)
        into = np.full(len(entries), NEVER)
        for (start, n, _), w in front.items():
            if start + n == first:
                into = np.maximum(into, w)
        between = 0.0 if self.kind == BYTE_PAIR else sum(self.best(u)[1] for u in split_words(text[first:last]))
        back = self.select(self.forward(text, last, hi, [START], hi), hi, exits)
        return into[:, None] + between + back

    def select(self, done: dict, cut: int, exits: list[State]) -> np.ndarray:
        rows = [done.get((cut + s, n, i)) for s, n, i in exits]
        size = len(next((r for r in rows if r is not None), [0]))
        return np.stack([np.full(size, NEVER) if r is None else r for r in rows], 1) if rows else np.zeros((size, 0))

    def edges(self, text: str, lo: int, hi: int) -> tuple[int | None, int | None]:
        """First and last place between two cuts where a word begins; none if there is no such place behind the entries' reach."""
        first = next((k for k in range(lo, hi) if boundary(text, k)), None)
        if first is None:
            return None, None
        last = next(k for k in range(hi - 1, first - 1, -1) if boundary(text, k))
        return first, last

    def path(self, text: str, entry: State, exit_: State | None, before: str = "") -> list[tuple[int, int]]:
        """(length, id) of the best path through a whole text that begins after ``entry``'s end and ends with ``exit_`` (any, if none).
        ``before`` is the text of the entry's piece.

        The path is searched longest piece first; for a byte-pair model the first one found is the only one.
        """
        if self.kind == UNIGRAM:
            return self.best(text)[0]
        ends, found = self.trace(text, entry, before)
        return [(b - a, i) for a, b, i in zip([0, *ends], ends, found, strict=False)]

    def trace(self, text: str, entry: State, before: str = "") -> tuple[list[int], list[int]]:
        """Ends and ids of the merge result that goes on from ``entry``, a piece spelled ``before``."""
        n, ids, joints, unknown = len(text), self.ids, self.joints, self.unknown
        trail: list[tuple[int, int, str, Iterator[int]]] = []
        dead: set[tuple[int, int]] = set()
        place, last = 0, entry[2]
        reach, lengths = self.reach.get, self.lengths
        options = iter(lengths(text, 0)) if n else iter(())
        while place < n:
            for size in options:
                end = place + size
                if end > n:
                    continue
                piece = text[place:end]
                i = ids.get(piece)
                if i is None:
                    if size > 1:
                        continue
                    i = unknown
                if dead and (end, i) in dead:
                    continue
                if last >= 0:
                    weight = joints.get(last << 32 | i)
                    if weight is None:
                        weight = self.step(last, before, i, piece)
                    if weight == NEVER:
                        continue
                trail.append((place, last, before, options))
                before, place, last = piece, end, i
                if place < n:
                    options = iter(reach(text[place : place + 3]) or lengths(text, place))
                break
            else:
                if not trail:
                    raise ValueError("the text has no segmentation")
                dead.add((place, last))
                place, last, before, options = trail.pop()
        if not n:
            return [], []
        return [t[0] for t in trail[1:]] + [n], [t[1] for t in trail[1:]] + [last]

    def best(self, text: str) -> tuple[list[tuple[int, int]], float]:
        """Viterbi path of a unigram model, and its weight."""
        weight, back = [0.0] + [NEVER] * len(text), [None] * (len(text) + 1)
        for at in range(len(text)):
            for n, i in self.starting(text, at):
                w = weight[at] + self.step(-1, "", i, "")
                if w > weight[at + n]:
                    weight[at + n], back[at + n] = w, (n, i)
        out, at = [], len(text)
        while at:
            out.append(back[at])
            at -= back[at][0]
        return out[::-1], weight[-1]

    def spelled(self, text: str, steps: list[tuple[int, int]]) -> tuple[int, ...]:
        """Ids of a path: unknown characters become bytes."""
        out, at = [], 0
        for n, i in steps:
            if i == self.unknown and self.byte_of:
                out += [self.byte_ids[b] for b in text[at : at + n].encode()]
            else:
                out.append(i)
            at += n
        return tuple(out)

    def word(self, text: str) -> list[int] | tuple[int, ...]:
        if text[:2] == SPACE * 2 and self.kind == BYTE_PAIR:  # runs of spaces tie with themselves: their merges have no single order of pairs
            return self.spelled(text, [(len(p), self.ids.get(p, self.unknown)) for p in self.merged_long(text)])
        if self.kind == BYTE_PAIR:
            ends, found = self.trace(text, START)
            if self.unknown not in found:
                return found
        return self.spelled(text, self.path(text, START, None))

    def merged_long(self, text: str) -> list[str]:
        """Merging of a word behind a run of spaces: the run but its last space merges with nothing else."""
        n = len(text) - len(text.lstrip(SPACE))
        rest = text[n - 1 :] if n < len(text) else ""
        tail = self.path(rest, START, None) if rest else []
        if rest and len(self.text_of(tail[0])) > 1 or not rest:
            run = text[: n - 1] if rest else text[:n]
            parts = self.merged(run) if run else []
            at, out = 0, []
            for size, _ in tail:
                out.append(rest[at : at + size])
                at += size
            return parts + out
        return self.merged(text)

    def text_of(self, step: tuple[int, int]) -> str:
        return self.pieces[step[1]]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a normalised text, word by word."""
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.units.findall(text))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The normalised text of ids."""
        out, at, pieces = [], 0, self.pieces
        is_byte = self.is_byte[ids]
        edges = np.flatnonzero(np.diff(is_byte, prepend=False, append=False)).reshape(-1, 2) if is_byte.any() else ()
        for x, y in edges:
            out += map(pieces.__getitem__, ids[at:x].tolist())
            out.append(bytes(self.byte_of[i] for i in ids[x:y].tolist()).decode(errors="replace"))
            at = y
        out += map(pieces.__getitem__, ids[at:].tolist())
        return "".join(out)


def boundary(text: str, k: int) -> bool:
    """Whether a word begins at a place: a space mark behind another character."""
    return 0 < k < len(text) and text[k] == SPACE and text[k - 1] != SPACE


def split_words(text: str) -> list[str]:
    """Words with the space marks before them."""
    return WORD.findall(text)


@lru_cache(maxsize=4)
def vocabulary(path: str, kind: str = BYTE_PAIR) -> Vocabulary:
    return Vocabulary(path, kind)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(1, initial=NEVER)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of all prefixes, by halves: pairs first, then the prefixes of the pairs, then the ones between."""
    if len(matrices) == 1:
        return matrices
    pairs = scan([times(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(pairs[k // 2] if k % 2 else times(pairs[k // 2 - 1], matrices[k]))
    return out


def cut_states(matrices: list[np.ndarray]) -> list[int]:
    """Which state the best path has at each inner cut: forward prefixes against backward ones."""
    ahead = scan(matrices)
    behind = [m.T for m in scan([m.T for m in reversed(matrices)])]
    out = []
    for k in range(len(matrices) - 1):
        through = ahead[k].max(0) + behind[len(matrices) - 2 - k].max(1)
        if through.max() == NEVER:
            raise ValueError("no path through the cuts")
        out.append(int(through.argmax()))
    return out


# Spark

CHUNKS = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("n_chunks", pa.int64()), ("left", pa.int64()), ("size", pa.int64()), ("body", pa.string())])


SLICE = 128


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def _whole(batches: Iterator[pa.RecordBatch], path: str, kind: str, summed: bool) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk, encoded, some at a time; with the columns of ``digests`` if ``summed``."""
    v = vocabulary(path, kind)
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.slice(at, SLICE)
            n = len(part)
            ids = [v.encode(v.model.normalize(t.as_py() or "")) for t in part.column(1)]
            columns = [part.column(0), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, np.int64))]
            if summed:
                yield pa.RecordBatch.from_arrays([*columns, *_sums(v, ids)], names=["doc_id", "chunk", "n_chunks", *SUMS])
            else:
                yield pa.RecordBatch.from_arrays([*columns, _lists(ids)], names=["doc_id", "chunk", "n_chunks", "ids"])


SUMS = ("n_ids", "ids", "ids_crc32", "n_chars", "text_crc32")


def _sums(v: Vocabulary, ids: list[np.ndarray]) -> list[pa.Array]:
    texts = [v.decode(x).replace(SPACE, " ") for x in ids]
    number = lambda x: pa.array(x, pa.int64())
    return [number([len(x) for x in ids]), _lists(ids), number([zlib.crc32(x.astype("<u4").tobytes()) for x in ids]), number([len(t) for t in texts]), number([zlib.crc32(t.encode()) for t in texts])]


def _chunks(batches: Iterator[pa.RecordBatch], path: str, kind: str, chunk: int) -> Iterator[pa.RecordBatch]:
    """Normalised texts, cut; each chunk has a halo of one piece on both sides."""
    from pyspark import TaskContext

    v, part, number = vocabulary(path, kind), TaskContext.get().partitionId(), 0
    reach = v.longest + 1
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text, number = v.model.normalize(text.as_py()), number + 1
            cuts = [*range(0, len(text), chunk), len(text)]
            rows = [(f"{part}-{number}", doc_id, k, len(cuts) - 1, min(lo, reach), hi - lo, text[max(0, lo - reach) : hi + reach]) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CHUNKS, strict=True)], schema=CHUNKS)


def _ends(v: Vocabulary, body: str, left: int, size: int, chunk: int, n_chunks: int) -> tuple[list[State], list[State]]:
    return [START] if chunk == 0 else v.covering(body, left), v.covering(body, left + size)


def _matrices(batches: Iterator[pa.RecordBatch], path: str, kind: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path, kind)
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            entries, exits = _ends(v, r["body"], r["left"], r["size"], r["chunk"], r["n_chunks"])
            if r["chunk"] == r["n_chunks"] - 1:
                exits = [s for s in exits if s[0] + s[1] == 0]
            m = v.matrix(r["body"], r["left"], r["left"] + r["size"], entries, exits)
            rows.append((r["row"], r["chunk"], m.shape[0], m.shape[1], m.astype(np.float64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())], ["row", "chunk", "n", "m", "matrix"])


MATRIX, STATES = "row string, chunk long, n long, m long, matrix binary", "row string, chunk long, entry long, exit long"


def _loaded(group: pa.Table) -> list[tuple[int, np.ndarray]]:
    """A document's neighbouring nodes in order, with their matrices."""
    rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
    return [(r["chunk"], np.frombuffer(r["matrix"]).reshape(r["n"], r["m"])) for r in rows]


def _product(group: pa.Table, fan: int) -> pa.Table:
    """One node of the next level: the product of its children."""
    nodes = _loaded(group)
    m = reduce(times, [x for _, x in nodes])
    return pa.table({"row": [group.column("row")[0].as_py()], "chunk": [nodes[0][0] // fan], "n": [m.shape[0]], "m": [m.shape[1]], "matrix": [m.tobytes()]})


def _states(row: str, nodes: list[tuple[int, np.ndarray]], entry: int, exit_: int) -> pa.Table:
    """States at the front and at the back of neighbouring nodes, given those at the front of the first and at the back of the last."""
    ms = [m for _, m in nodes]
    ms[0] = ms[0][entry : entry + 1]
    ms[-1] = ms[-1][:, exit_ : exit_ + 1]
    inner = cut_states(ms) if len(ms) > 1 else []
    return pa.table({"row": [row] * len(ms), "chunk": [k for k, _ in nodes], "entry": pa.array([entry, *inner], pa.int64()), "exit": pa.array([*inner, exit_], pa.int64())})


def _top(group: pa.Table) -> pa.Table:
    nodes = _loaded(group)
    last = int(reduce(times, [m for _, m in nodes])[0].argmax())
    return _states(group.column("row")[0].as_py(), nodes, 0, last)


def _below(nodes: pa.Table, parent: pa.Table) -> pa.Table:
    return _states(parent.column("row")[0].as_py(), _loaded(nodes), parent.column("entry")[0].as_py(), parent.column("exit")[0].as_py())


def cut_tree(matrices: DataFrame, longest: int, fan: int) -> DataFrame:
    """The states at both ends of every chunk, by products up a tree and choices down it. ``longest`` is the number of chunks of the longest document."""
    up, levels = F.floor(F.col("chunk") / fan).alias("up"), [matrices]
    while longest > fan:
        levels.append(written(levels[-1].groupBy("row", up).applyInArrow(lambda t: _product(t, fan), MATRIX), "matrices"))
        longest = -(-longest // fan)
    states = levels.pop().groupBy("row").applyInArrow(_top, STATES)
    while levels:
        parents = states.withColumnRenamed("chunk", "up")
        states = levels.pop().groupBy("row", up).cogroup(parents.groupBy("row", "up")).applyInArrow(_below, STATES)
    return states


def _traced(batches: Iterator[pa.RecordBatch], path: str, kind: str) -> Iterator[pa.RecordBatch]:
    """Ids of the pieces that begin in each chunk."""
    v = vocabulary(path, kind)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            body, left, size = r["body"], r["left"], r["size"]
            entries, exits = _ends(v, body, left, size, r["chunk"], r["n_chunks"])
            if r["chunk"] == r["n_chunks"] - 1:
                exits = [s for s in exits if s[0] + s[1] == 0]
            entry, exit_ = entries[r["entry"]], exits[r["exit"]]
            begin, end = left + entry[0] + entry[1], left + size + exit_[0]
            if end < begin:  # one piece lies across the whole chunk
                ids: list[int] = []
            else:
                ids = traced(v, body, begin, end, entry, left)
                if exit_[0] >= -size:
                    ids += v.spelled(body[end : end + exit_[1]], [(exit_[1], exit_[2])])
            out.append((r["doc_id"], r["chunk"], r["n_chunks"], ids))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], ["doc_id", "chunk", "n_chunks", "ids"])


def traced(v: Vocabulary, body: str, begin: int, end: int, entry: State, left: int) -> list[int]:
    """Ids between two places that the best path passes: the word the first lies in is searched on from its last piece."""
    first, _ = v.edges(body, begin, end)
    stop = end if first is None else first
    ids: list[int] = []
    if begin < stop:
        ids += v.spelled(body[begin:stop], after(v, body, begin, stop, entry, left))
    if first is not None:
        ids += v.encode(body[first:end]).tolist()
    return ids


def after(v: Vocabulary, body: str, begin: int, stop: int, entry: State, left: int) -> list[tuple[int, int]]:
    """The path from a place to another, given the piece before the first."""
    if v.kind == UNIGRAM or entry[2] < 0 or boundary(body, begin):
        return v.path(body[begin:stop], START, None)
    return v.path(body[begin:stop], entry, None, body[begin - entry[1] : begin])


def encode(docs: DataFrame, model: str, kind: str = BYTE_PAIR, chunk: int = CHUNK, summed: bool = False, fan: int = FAN) -> DataFrame:
    """Per chunk of each row: doc_id, chunk, n_chunks, ids of the pieces that begin in it (in order).

    ``summed`` adds, in the same pass, n_ids, ids_crc32, and of the decoded text n_chars and text_crc32.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long_ = F.coalesce(F.char_length("text"), F.lit(0)) > chunk
    own = "doc_id long, chunk long, n_chunks long, " + ("n_ids long, ids array<int>, ids_crc32 long, n_chars long, text_crc32 long" if summed else "ids array<int>")
    whole = rows.where(~long_).mapInArrow(lambda b: _whole(b, model, kind, summed), own)
    schema = "row string, doc_id long, chunk long, n_chunks long, left long, size long, body string"
    giant = written(rows.where(long_).mapInArrow(lambda b: _chunks(b, model, kind, chunk), schema), "chunks")
    longest = giant.agg(F.max("n_chunks")).first()[0]
    if not longest:
        return whole
    matrices = written(giant.repartition("row", "chunk").mapInArrow(lambda b: _matrices(b, model, kind), MATRIX), "matrices")
    states = cut_tree(matrices, longest, fan)
    back = giant.join(states, ["row", "chunk"]).select("doc_id", "chunk", "n_chunks", "left", "size", "body", "entry", "exit")
    traced_ = back.mapInArrow(lambda b: _traced(b, model, kind), "doc_id long, chunk long, n_chunks long, ids array<int>")
    return whole.unionByName(digests(traced_, model, kind) if summed else traced_)


def decode(encoded: DataFrame, model: str, kind: str = BYTE_PAIR) -> DataFrame:
    """``text`` beside the other columns: the normalised text of ``ids``, with spaces for space marks. The mark that the
    model puts before a text becomes a space too; a reader that joins a document's chunks drops the first one."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, kind)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            texts = pa.array([v.decode(np.array(x.as_py() or [], np.int32)).replace(SPACE, " ") for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(decoded, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, text string")


def digests(encoded: DataFrame, model: str, kind: str = BYTE_PAIR) -> DataFrame:
    """Per chunk: doc_id, chunk, n_chunks, n_ids, ids, ids_crc32, and of the decoded text its characters and crc32."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, kind)
        for batch in batches:
            ids = [np.array(x.as_py() or [], np.int32) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *_sums(v, ids)], names=["doc_id", "chunk", "n_chunks", *SUMS])

    return encoded.mapInArrow(summed, "doc_id long, chunk long, n_chunks long, n_ids long, ids array<int>, ids_crc32 long, n_chars long, text_crc32 long")
