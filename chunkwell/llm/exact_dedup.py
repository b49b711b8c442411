"""Exact duplicates by deterministic block naming.

A normalised text is cut into fixed-size blocks. Equal blocks are sorted together and
named by the first place, in order of doc_id and block number, at which that block occurs: the number
of its row and of the block, two integers that cannot collide. Then adjacent names are
paired, equal pairs are named by their first place in the same way, and so on until
each document has one name. As all names are first places, the last one of a document
is the identity of its whole text. Text is shuffled at the first level only; above it
a block is a few integers, and documents that are down to one name drop out.

Equal blocks are grouped with partial aggregation and names return by a join that
adaptive execution may split, so a group of any number of copies is never in one task.

Nulls and edge cases: a null text is an empty one; a null id is an id of its own kind
that sorts first; rows that repeat an id are one document if their texts are equal and
count once each in ``group_size``; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, first_rows, written

BLOCK = 8192


def normalised(text):
    """Each run of white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


def _named(rows: DataFrame, content: list[str], carry: list[str]) -> DataFrame:
    """The rows' ``carry`` columns with (name_row, name_idx), the first place (row and block) that has their content."""
    names = rows.groupBy(*content).agg(F.min(F.struct("doc_id", "rid", "idx")).alias("f")).select(*content, F.col("f.rid").alias("name_row"), F.col("f.idx").alias("name_idx"))
    left, right = rows.alias("l"), names.alias("r")
    same = F.lit(True)
    for c in content:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same).select(*[F.col(f"l.{c}") for c in carry], "r.name_row", "r.name_idx")


def _named_blocks(blocks: DataFrame) -> DataFrame:
    """The first level: blocks are sorted and named by their bytes, and the names go back to the rows by a digest.

    The digest is an address only: two blocks of one digest would be seen below, and then names go back by bytes. So
    the bytes are shuffled once, for the sort, after each task has dropped its repeats, and rows of a frequent block
    meet its name in a join that adaptive execution can split.
    """
    names = blocks.groupBy("block").agg(F.min(F.struct("doc_id", "rid", "idx")).alias("f"))
    names = written(names.select(F.unhex(F.sha2("block", 256)).alias("digest"), F.col("f.rid").alias("name_row"), F.col("f.idx").alias("name_idx")), "blocks")
    if not names.groupBy("digest").count().where("count > 1").isEmpty():
        return _named(blocks, ["block"], CARRY)
    rows = blocks.select(*CARRY, F.unhex(F.sha2("block", 256)).alias("at"))
    return rows.join(names.hint("merge"), F.col("at") == F.col("digest")).select(*CARRY, "name_row", "name_idx")


CARRY = ["rid", "doc_id", "idx", "n", "n_blocks", "sha"]


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rid, doc_id, sha, n_blocks, name_row, name_idx) of each row; texts are equal where the last three are.

    ``rid`` tells rows apart that share an id.
    """
    text = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.encode(normalised(F.col("text")), "UTF-8").alias("t"))
    n = F.greatest(F.ceil(F.octet_length("t") / F.lit(block)), F.lit(1)).cast("long")
    cut = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("n")),
        lambda i: F.struct(
            F.substring(F.col("t"), ((i - 1) * block + 1).cast("int"), F.lit(block)).alias("block"),
            F.when(i == 1, F.unhex(F.sha2(F.col("t"), 256))).alias("sha"),
        ),
    )
    blocks = text.withColumn("n", n).select("rid", "doc_id", "n", F.col("n").alias("n_blocks"), F.posexplode(cut).alias("pos", "b"))
    blocks = blocks.select("rid", "doc_id", F.col("pos").cast("long").alias("idx"), "n", "n_blocks", F.col("b.sha").alias("sha"), F.col("b.block").alias("block"))
    level = written(_named_blocks(blocks), "names-0")
    done = level.where("n = 1")
    longest = level.agg(F.max("n")).first()[0] or 1
    k = 0
    while longest > 1:  # as often as the longest text can be halved
        k += 1
        at = lambda odd, c: F.max(F.when(F.col("idx") % 2 == odd, F.col(c)))
        pairs = (
            level.where("n > 1")
            .withColumn("half", F.floor(F.col("idx") / 2).cast("long"))
            .groupBy("rid", "half")  # one or two names
            .agg(
                F.max("doc_id").alias("doc_id"), F.ceil(F.max("n") / 2).cast("long").alias("n"), F.max("n_blocks").alias("n_blocks"), F.max("sha").alias("sha"),
                at(0, "name_row").alias("a_doc"), at(0, "name_idx").alias("a_idx"), at(1, "name_row").alias("b_doc"), at(1, "name_idx").alias("b_idx"),
            )
            .withColumnRenamed("half", "idx")
        )
        level = written(_named(pairs, ["a_doc", "a_idx", "b_doc", "b_idx"], CARRY), f"names-{k}")
        done = done.unionByName(level.where("n = 1"))
        longest = -(-longest // 2)
    return done.drop("idx", "n")


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each row: keep_id, the smallest doc_id with an equal text; group_size; kept; text_sha256."""
    who = identities(docs, block)
    key = ["n_blocks", "name_row", "name_idx"]
    sizes = who.groupBy(*key).agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    left, right = who.alias("w"), sizes.alias("s")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"w.{c}").eqNullSafe(F.col(f"s.{c}"))
    return left.join(right, same).select(
        F.col("w.rid"),
        F.col("w.doc_id"),
        F.col("s.first.doc_id").alias("keep_id"),
        F.col("s.group_size"),
        (F.col("w.rid") == F.col("s.first.rid")).alias("kept"),
        F.lower(F.hex("w.sha")).alias("text_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of equal texts, with its columns."""
    kept = groups(docs).where("kept").select(F.col("doc_id").cast("long").alias("id"), F.col("text_sha256").alias("sha"))
    return first_rows(docs, F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256), kept)
