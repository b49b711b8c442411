"""The block locality cache as a filter: chunks that lie in blocks near the ones where their neighbours were found.

Data that is written again mostly comes in the old order, so a chunk's copy is likely as far away as the copies of the chunks beside it were. The state of a stream of
blocks is therefore three small tables: which blocks are at hand, what distances paid lately, and where a fingerprint was last written. A
block is handled as one set of fingerprints: those at hand are found at once; for the rest, blocks at paying distances are brought in, best distance first, until nothing
is missing; then all found ones vote for their distances.

The state depends on all blocks before, so requests are replayed in order within segments. A segment first replays the last requests of the one before it, without
reporting them, so that it does not begin with nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EMPTY_FP

SEGMENT, WARM = 4096, 512  # requests that one state reports, and requests before them that it only learns from


@dataclass(frozen=True)
class LocalityOptions:
    blocks: int = 1024  # blocks at hand
    distances: int = 16  # distances that are remembered
    least_votes: int = 1  # before a distance is tried
    ahead: int = 0  # further blocks brought in behind one that was


@dataclass
class LocalityState:
    """What a stream of blocks has left: all tables are ordered by last use, the oldest entry goes first."""

    options: LocalityOptions
    written: dict[int, frozenset[str]] = field(default_factory=dict)
    at_hand: dict[int, None] = field(default_factory=dict)
    votes: dict[int, int] = field(default_factory=dict)
    last: dict[str, int] = field(default_factory=dict)
    holder: dict[str, int] = field(default_factory=dict)  # the block that was brought in last with a fingerprint
    brought: int = 0

    def bring(self, block: int) -> bool:
        """A written block is at hand afterwards, as the one used last."""
        if block not in self.written:
            return False
        self.brought += block not in self.at_hand
        self.at_hand.pop(block, None)
        self.at_hand[block] = None
        self.holder.update(dict.fromkeys(self.written[block], block))
        while len(self.at_hand) > self.options.blocks:
            del self.at_hand[next(iter(self.at_hand))]
        return True

    def among(self, wanted: set[str], blocks) -> dict[str, int]:
        """Which of the fingerprints lie in the blocks, and in which; the last one wins."""
        return {fp: b for b in blocks for fp in wanted & self.written[b]}

    def lookup(self, block: int, wanted: set[str]) -> dict[str, int]:
        """Fingerprint -> block at hand that holds it, after paying distances were tried."""
        found = {fp: b for fp in wanted if (b := self.holder.get(fp)) in self.at_hand}
        paying = sorted((d for d, v in self.votes.items() if v >= self.options.least_votes), key=lambda d: (-self.votes[d], d))
        for d in paying:
            missing = wanted - found.keys()
            if not missing:
                break
            near = [b for b in range(block + d, block + d + 1 + self.options.ahead) if b != block and b not in self.at_hand]
            found |= self.among(missing, [b for b in near if self.bring(b)])
        return found

    def settle(self, block: int, wanted: set[str], found: dict[str, int]) -> None:
        """Found fingerprints, and others that were written before, vote for how far away they are; the block is written."""
        for fp in wanted:
            if fp not in found and fp in self.last:
                found = found | {fp: self.last[fp]}
        for d, n in sorted(Counter(b - block for b in found.values() if b != block).items(), key=lambda x: (x[1], x[0])):
            self.votes[d] = self.votes.pop(d, 0) + n
        while len(self.votes) > self.options.distances:
            del self.votes[next(iter(self.votes))]
        for b in dict.fromkeys(found.values()):
            if b in self.at_hand:
                self.bring(b)
        self.written[block] = self.written.get(block, frozenset()) | wanted
        self.last.update(dict.fromkeys(wanted, block))


FOUND = "segment long, block_id long, fp string, cached_block long"


def replayed(rows: Iterator[tuple[int, int, str]], options: LocalityOptions) -> Iterator[tuple[int, int, dict[str, int]]]:
    """(write_seq, block_id, fp) in order -> (write_seq, block_id, found) of each visit to a block."""
    state, here, wanted = LocalityState(options), None, set()
    for seq, block, fp in rows:
        if here != (seq, block):
            if here is not None:
                found = state.lookup(here[1], wanted)
                yield *here, found
                state.settle(here[1], wanted, found)
            here, wanted = (seq, block), set()
        wanted.add(fp)
    if here is not None:
        yield *here, state.lookup(here[1], wanted)


def replay_locality(items: DataFrame, options: LocalityOptions = LocalityOptions(), segment: int = SEGMENT, warm: int = WARM) -> DataFrame:  # noqa: B008
    """items (write_seq, block_id, fp) -> (write_seq, block_id, fp, cached_block) of the chunks that the cache finds; the empty fingerprint is never looked up."""

    def task(group: pa.Table) -> pa.Table:
        number = group.column("segment")[0].as_py()
        group = group.sort_by([("write_seq", "ascending"), ("block_id", "ascending"), ("fp", "ascending")])
        rows = zip(*(group.column(n).to_pylist() for n in ("write_seq", "block_id", "fp")), strict=True)
        out = [(seq, block, fp, held) for seq, block, found in replayed(rows, options) if seq >= number * segment for fp, held in sorted(found.items())]
        kinds = [("write_seq", pa.int64()), ("block_id", pa.int64()), ("fp", pa.string()), ("cached_block", pa.int64())]
        return pa.table([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=[n for n, _ in kinds])

    own = F.floor(F.col("write_seq") / segment)
    warmed = F.when(F.pmod("write_seq", F.lit(segment)) >= segment - warm, F.array(own, own + 1)).otherwise(F.array(own))
    rows = items.where(F.col("fp") != EMPTY_FP).select("write_seq", "block_id", "fp").distinct().select("*", F.explode(warmed).alias("segment"))
    return rows.groupBy("segment").applyInArrow(task, "write_seq long, block_id long, fp string, cached_block long")
