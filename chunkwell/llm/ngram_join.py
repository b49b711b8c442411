"""Similarity join on sets of word 5-grams, with Bayesian pruning of candidates.

1. Rows with equal word sequences are copies of one text; only one row of each text goes on.
2. MinHash values of a text (128) are banded by four. Texts that share a band are linked to the band's
   smallest row: a star, not all pairs. Two texts of similarity 0.8 share no band
   with probability 5e-8, and less the more alike they are. Stars join into components; everything similar is in one component.
   Texts that share much boilerplate can meet in a large component without being similar. Components that are larger than a block are taken apart by an exact
   rule: of two texts at the threshold, the rarest fifth of one's n-grams and of the other's have one in common. Stars over these rare n-grams join
   into finer components; boilerplate is frequent and joins nothing.
3. Within a component, MinHash values of pairs are compared sixteen at a time. Under a uniform prior the
   posterior probability that the similarity reaches the threshold, given the matches so far, is a
   binomial tail; pairs for which it falls below 1e-9 are dropped. The rest are verified exactly on their n-gram sets.
4. Verified links are counted for each text, and joined into classes.

Components are worked on in units of bounded size: small ones share a unit, large ones are
cut into blocks, and each pair of blocks is a unit of its own. A unit's pairs
live in arrays of its worker; what it returns is one row a text. So no pair is ever a row,
and a group of any size is spread over as many tasks as it needs.

All joins but that with the bitmaps are merged, by hint: Spark sizes a table before it has run, takes a list of bands for a few bytes, and would send
millions of them through the driver.

Nulls and edge cases: a null text is empty. Texts without words are copies of each other and link to
nothing else; texts of one to four words have one n-gram, all their words. Rows may repeat ids or be equal, each gets a
row in the result. An empty table gives an empty result. Further columns are ignored. ``stage`` keeps one row of each class
with all its columns: the one of the smallest id, rows without an id last; rows of one id, or none, are told apart by their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dealt_anew, first_rows, written

N = 5
THRESHOLD = 0.8
TOLERANCE = 1e-9
HASHES, BAND, STEP = 128, 4, 16
BLOCK_TEXTS, BLOCK_GRAMS = 512, 500_000
MAP_BITS, MAP_PART = 1 << 25, 32768  # Spark's bitmaps have parts of 32,768 bits
RARITY_BITS = 18  # n-grams are counted in 2 ** 18 places, whatever the corpus: 2 MB
U64 = np.uint64


class _Words(dict):
    """64-bit hashes of words, kept; emptied when there are 150,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@cache
def _multipliers(n: int, seed: int = 1) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def grams(words: list[bytes], n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of all words, if they are fewer than n."""
    if not words:
        return np.empty(0, U64)
    w = np.fromiter(map(_words.__getitem__, words), U64, len(words))
    n = min(n, len(w))
    factors = _multipliers(N, 7)
    total = np.zeros(len(w) - n + 1, U64)
    for k in range(n):
        total += _mix(w[k : len(w) - n + 1 + k] + factors[k]) * factors[k]
    return np.unique(_mix(total))


def signature(g: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """MinHash values of a non-empty set."""
    a = _multipliers(hashes)[:, None]
    low = None
    for at in range(0, len(g), 4096):
        part = (a * g[None, at : at + 4096]).min(1)
        low = part if low is None else np.minimum(low, part)
    return low >> U64(32)


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among n MinHash values that keep P(similarity >= threshold), under a uniform prior, at the tolerance."""
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes, bands = [], [], []
        for text in batch.column(2):
            words = split_words(text.as_py())
            g = grams(words)
            digests.append(digest(words))
            sizes.append(len(g))
            if len(g):
                s = signature(g).reshape(-1, BAND)
                key = np.arange(1, len(s) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
                for k in range(BAND):
                    key = _mix(key ^ s[:, k])
                bands.append(key.view(np.int64))
            else:
                bands.append([])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["rid", "doc_id", "sha", "digest", "n_grams", "bands"],
        )


def _similar(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float, tolerance: float) -> np.ndarray:
    """Boolean matrix of the pairs (a[i], b[j]) whose similarity reaches the threshold; b None: pairs within a, both ways."""
    other = a if b is None else b
    na, nb = np.array([len(g) for g in a]), np.array([len(g) for g in other])
    alive = np.minimum(na[:, None], nb[None]) >= threshold * np.maximum(na[:, None], nb[None]) - 1e-9
    if b is None:
        alive &= np.tri(len(a), k=-1, dtype=bool).T
    i, j = np.nonzero(alive)
    if not len(i):
        return np.zeros(alive.shape, bool)
    sa = np.array([signature(g) for g in a])
    sb = sa if b is None else np.array([signature(g) for g in other])
    matches = np.zeros(len(i), np.int16)
    for at in range(0, HASHES, STEP):
        least = least_matches(at + STEP, threshold, tolerance)
        for lo in range(0, len(i), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            matches[part] += (sa[i[part], at : at + STEP] == sb[j[part], at : at + STEP]).sum(1, dtype=np.int16)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
        if not len(i):
            return np.zeros(alive.shape, bool)
    if len(i) <= 4 * (len(a) + len(other)):
        shared = np.fromiter((len(np.intersect1d(a[x], other[y], assume_unique=True)) for x, y in zip(i, j, strict=True)), np.int64, len(i))
    else:
        shared = _shared(a, other, b is None)[i, j]
    found = np.zeros(alive.shape, bool)
    ok = shared * (1 + threshold) >= threshold * (na[i] + nb[j]) - 1e-9
    found[i[ok], j[ok]] = True
    return found | found.T if b is None else found


def _shared(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> np.ndarray:
    """How many n-grams each pair shares, as a product of incidence matrices, some columns at a time."""
    every = a if same else a + b
    lengths = [len(g) for g in every]
    grams_of, column, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    order = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(every)), lengths)
    use = count[column] > 1
    row, column = row[use], order[column[use]]
    total = np.zeros((len(a), len(b)), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    width = 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(every), width), np.float32)
        m[row[x:y], column[x:y] - lo] = 1
        total += m[: len(a)] @ (m if same else m[len(a) :]).T
    return np.rint(total).astype(np.int64)


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index that each index of a symmetric boolean matrix reaches."""
    label = np.arange(len(adjacent))
    while True:
        low = np.where(adjacent, label[None], len(label)).min(1, initial=len(label))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


UNIT = pa.schema([("rid", pa.int64()), ("to", pa.int64()), ("n_links", pa.int64())])


def _verify(unit: pa.Table, threshold: float, tolerance: float) -> pa.Table:
    """Of the texts of a unit: links, and the smallest row that verified links reach. All texts of a component's two blocks are here."""
    got: dict[int, dict[int, tuple[int, np.ndarray]]] = {}
    want = (unit.column("block_a")[0].as_py(), unit.column("block_b")[0].as_py()) if len(unit) else (0, 0)
    for comp, rid, block, code, text in zip(*(unit.column(c) for c in ("comp", "rid", "block", "digest", "text")), strict=True):
        words = split_words(text.as_py())
        if digest(words) == code.as_py():  # else another row with the same id
            got.setdefault(comp.as_py(), {})[rid.as_py()] = (block.as_py(), grams(words))
    rows: list[tuple[int, int, int]] = []
    for texts in got.values():
        rids = np.array(sorted(texts))
        sets, block = [texts[r][1] for r in rids], np.array([texts[r][0] for r in rids])
        if want[0] == want[1]:
            links = _similar(sets, None, threshold, tolerance)
        else:
            x, y = np.flatnonzero(block == want[0]), np.flatnonzero(block == want[1])
            links = np.zeros((len(rids), len(rids)), bool)
            if len(x) and len(y):
                links[np.ix_(x, y)] = _similar([sets[k] for k in x], [sets[k] for k in y], threshold, tolerance)
                links |= links.T
        label = _labels(links)
        rows += zip(rids.tolist(), rids[label].tolist(), links.sum(1).tolist(), strict=True)
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], schema=UNIT)


def _sha(text):
    """Digest of a text, which tells rows apart that share an id."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def _star_edges(keyed: DataFrame) -> DataFrame:
    """keyed (rid, key) -> edges (a, b) between rows that share a key, by way of each key's smallest row."""
    stars = keyed.groupBy("key").agg(F.min("rid").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # A text meets many hubs. It is linked to the smallest, and so are the other hubs, which many texts share: the same components from fewer edges.
    hubs = keyed.join(dealt_anew(stars, "key"), "key").groupBy("rid").agg(F.collect_set("hub").alias("hubs")).withColumn("b", F.array_min("hubs"))
    return hubs.select(F.explode(F.array_union("hubs", F.array("rid"))).alias("a"), "b").where("a <> b").distinct()


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (rid, doc_id, sha, ...) with their ``text``. Rows of one id and text are copies; one of them is enough.

    Texts are shuffled for the join, so those that no row asks for are left out before: by a bitmap of fixed size (MAP_BITS bits, 4 MB at most) over hashes of ids and
    digests, which lets some others pass, and all of them once the rows are too many for it.
    """
    # Merged at every size: neither side has a bound, and shuffles then grow as the input does.
    place = lambda i, h: F.expr(f"pmod(xxhash64({i}, {h}), {MAP_BITS}L)")
    asked = rows.select(place("doc_id", "sha").alias("p")).groupBy(F.floor(F.col("p") / MAP_PART).alias("_part")).agg(F.bitmap_construct_agg(F.col("p") % MAP_PART).alias("_map"))
    texts_of = docs.select(F.col("doc_id").cast("long").alias("_id"), _sha(F.col("text")).alias("_sha"), "text")
    found = texts_of.withColumn("_p", place("_id", "_sha")).withColumn("_part", F.floor(F.col("_p") / MAP_PART)).join(F.broadcast(asked), "_part")
    byte = F.conv(F.hex(F.substring("_map", (F.floor(F.col("_p") % MAP_PART / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    found = found.withColumn("_byte", byte).where("shiftright(_byte, cast(_p % 8 as int)) & 1 = 1")
    got = rows.hint("merge").join(found.select("_id", "_sha", "text"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))).drop("_id", "_sha")
    return got.dropDuplicates(["rid"])


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, comp, digest, text) -> (rid, comp, grams)."""
    for batch in batches:
        sets = [grams(split_words(t.as_py())).tobytes() for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["rid", "comp", "grams"])


def _rarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n): how many texts of a task have an n-gram in each place."""
    total = np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            total += np.bincount((np.frombuffer(raw.as_py(), U64) >> U64(64 - RARITY_BITS)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])


def rare_first(g: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """So many of a set's n-grams, the rarest first, that two sets at the threshold have one of theirs in common (any one order of all n-grams will do)."""
    order = np.lexsort((g, counts[(g >> U64(64 - RARITY_BITS)).astype(np.int64)]))
    return g[order[: len(g) - int(np.ceil(threshold * len(g) - 1e-9)) + 1]]


def _finer(large: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """large (rid, comp, doc_id, sha, digest) -> (rid, comp) by stars over rare n-grams, within the components as they are; texts that share none drop out."""
    sets = written(_with_text(large, docs).select("rid", "comp", "digest", "text").mapInArrow(_gram_rows, "rid long, comp long, grams binary"), "grams")
    counted = sets.select("grams").mapInArrow(_rarity, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # 2 ** RARITY_BITS rows at most
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    counts[counted["place"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for comp, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = _mix(np.array([comp], np.int64).view(U64) + U64(1))
                keys.append(_mix(rare_first(np.frombuffer(raw.as_py(), U64), counts, threshold) ^ own).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["rid", "keys"])

    edges = _star_edges(sets.mapInArrow(keyed, "rid long, keys array<long>").select("rid", F.explode("keys").alias("key")))
    return components(edges, "fine").select(F.col("node").alias("rid"), F.col("label").alias("comp"))


def _sized(members: DataFrame) -> DataFrame:
    """members (rid, comp, n_grams, ...) with ``blocks``, the number of blocks that their component is cut into."""
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("g"))
    sizes = sizes.select("comp", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("long").alias("blocks"))
    return members.join(dealt_anew(sizes, "comp"), "comp")


def _classed(docs: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, digest); texts (digest, copy_id, n_copies, n_links, label); classes (label, first), where ``first``
    has the doc_id and sha of the class's row of smallest id, rows without an id last.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text", _sha(F.col("text")).alias("sha"))
    sketches = written(rows.mapInArrow(_sketch, "rid long, doc_id long, sha binary, digest binary, n_grams long, bands array<long>"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha")).alias("first")
    texts = written(
        sketches.groupBy("digest").agg(F.min(F.struct("rid", "doc_id", "sha", "n_grams")).alias("s"), first, F.count(F.lit(1)).alias("n_copies")).select("digest", "s.*", "first", "n_copies"), "texts"
    )
    bands = sketches.join(texts.select("rid").hint("merge"), "rid", "left_semi").select("rid", F.explode("bands").alias("key"))
    members = components(_star_edges(bands), "near").select(F.col("node").alias("rid"), F.col("label").alias("comp"))

    known_texts = texts.select("rid", "doc_id", "sha", "digest", "n_grams")
    placed = written(_sized(members.hint("merge").join(known_texts, "rid")), "members")
    if not placed.where("blocks > 1").isEmpty():
        finer = _finer(placed.where("blocks > 1"), docs, threshold)
        finer = finer.hint("merge").join(known_texts, "rid").select("rid", "comp", "doc_id", "sha", "digest", "n_grams")
        whole = placed.where("blocks = 1").select("rid", "comp", "doc_id", "sha", "digest", "n_grams")
        placed = written(_sized(whole.unionByName(finer)), "finer-members")
    placed = placed.withColumn("block", F.expr("pmod(xxhash64(rid), blocks)"))
    units = max(1, int((placed.agg(F.sum("n_grams")).first()[0] or 0) / BLOCK_GRAMS) + 1)
    # A block meets every block of its component, itself included; a small component has one block and shares its unit with others.
    other = F.explode(F.expr("sequence(0L, blocks - 1)"))
    with_text = _with_text(placed, docs)
    spread = with_text.select("comp", "rid", "digest", "text", "block", "blocks", other.alias("other")).select(
        "comp", "rid", "digest", "text", "block", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"),
        F.when(F.col("blocks") == 1, F.expr(f"pmod(xxhash64(comp), {units}L)")).otherwise(F.col("comp")).alias("unit"), (F.col("blocks") == 1).alias("small"),
    )
    verified = written(
        spread.groupBy("unit", "small", "block_a", "block_b").applyInArrow(lambda t: _verify(t, threshold, tolerance), "rid long, to long, n_links long"), "verified"
    )
    links = verified.groupBy("rid").agg(F.sum("n_links").alias("n_links"))
    joined = components(verified.where("rid <> to").select(F.col("rid").alias("a"), F.col("to").alias("b")), "classes")
    known = texts.join(links.hint("merge"), "rid", "left").join(joined.withColumnRenamed("node", "rid").hint("merge"), "rid", "left")
    known = known.select("digest", "first", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("label", "rid").alias("label"))
    lowest = known.groupBy("label").agg(F.min("first").alias("first"))
    return sketches, known.withColumn("copy_id", F.col("first.doc_id")).drop("first"), lowest


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row: doc_id; class_id, the smallest doc_id among all texts that verified links join; n_links, other texts at or
    above the threshold; copy_id, the smallest doc_id with the same words; n_copies, rows with the same words.
    """
    sketches, known, lowest = _classed(docs, threshold, tolerance)
    classes = known.join(dealt_anew(lowest.select("label", F.col("first.doc_id").alias("class_id")), "label"), "label").drop("label")
    return sketches.select("doc_id", "digest").join(classes.hint("merge"), "digest").select("doc_id", "class_id", "n_links", "copy_id", "n_copies")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, one with the smallest id, with its columns; rows without an id, or of one id, are told apart by their texts."""
    kept = _classed(docs, THRESHOLD, TOLERANCE)[2].select(F.col("first.doc_id").alias("id"), F.col("first.sha").alias("sha"))
    return first_rows(docs, _sha(F.col("text")), kept)
