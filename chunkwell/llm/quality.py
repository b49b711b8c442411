"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps its outcome as a
bit and what was measured as a column; policies (named, versioned sets of bits) and
ablations then need the ledger only, and never the text again. All of it is built-in
column expressions in one projection: no shuffle, no Python.

Nulls and edge cases: a null text has no words, so it fails the word count; an empty
text does too. Rows are judged one by one, so repeated rows and ids change nothing,
an empty table gives an empty ledger, and further input columns are ignored unless
``keep`` names them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, bind

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``failed`` (SQL over the ledger's measurements) holds."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "stuttering", "10 * n_stutter_words > 3 * n_words"),
    Rule(5, "word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule(6, "undecodable", "100 * n_bad_chars > word_chars"),
)

#: name -> rules whose failure rejects a document. A version is never changed, only added.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": tuple(r.name for r in RULES),
}


def policy_mask(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _chars(text: Column, drop: str) -> Column:
    """How many characters of ``text`` are in ``drop``."""
    return F.char_length(text) - F.char_length(F.translate(text, drop, ""))


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more, the first occurrence included.

    Texts without a repeated hash, nearly all, leave after a hash set over longs; the others
    sort windows by hash and words, keep what equals a neighbour word by word and add up the words each such window adds.
    """

    def covered(starts: Column) -> Column:
        gap = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.slice(words, i + 1, WINDOW).alias("w"), i.alias("i"))))
        equal = lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))
        same = lambda s: F.filter(s, lambda x, j: ((j > 0) & equal(F.get(s, j - 1), x)) | equal(F.get(s, j + 1), x))
        starts = bind(marked, lambda s: F.array_sort(F.transform(same(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bind(starts, covered))

    def windows(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(0), n - WINDOW)
        return F.when(n > WINDOW, bind(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])), repeated)).otherwise(F.lit(0).cast("long"))

    return windows(words)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and the failure bits (``failed_rules``, a long) of every document."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    measured = bind(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda s: bind(
            s["w"],
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x))).cast("long").alias("n_stutter_words"),
                F.size(s["l"]).cast("long").alias("n_lines"),
                (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
            ),
        ),
    )
    flat = docs.select(
        F.col(id_col).alias("doc_id"),
        *keep,
        measured.alias("_m"),
        (F.char_length(t) - _chars(t, SPACE_CHARS)).cast("long").alias("word_chars"),
        _chars(t, "#*$%&|<>").cast("long").alias("n_symbols"),
        _chars(t, "�").cast("long").alias("n_bad_chars"),
    ).select("*", "_m.*")
    bits = [F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return flat.drop("_m").withColumn("failed_rules", mask)


def apply_policy(ledger_df: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: no bit of the policy is set."""
    return ledger_df.withColumn("kept", F.col("failed_rules").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0)


def ablations(ledger_df: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, that only it rejects, and that are kept without it.

    The ledger is first counted by mask (at most 2^rules rows), so the rest is independent of the corpus.
    """
    full = policy_mask(policy)
    masks = ledger_df.groupBy("failed_rules").agg(F.count(F.lit(1)).alias("n"))
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy]])
    got = masks.select("failed_rules", "n", F.inline(named))
    seen = F.col("failed_rules").bitwiseAND(F.lit(full).cast("long"))
    rest = F.col("failed_rules").bitwiseAND(F.lit(full).cast("long").bitwiseXOR(F.col("bit")))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return got.groupBy("rule").agg(
        count(F.col("failed_rules").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(seen == F.col("bit")).alias("n_only_this"),
        count(rest == 0).alias("n_kept_without"),
        count(seen == 0).alias("n_kept"),
    )


def verdicts(docs: DataFrame, policy: str = "web-1") -> DataFrame:
    """The contract's columns: measurements, the base verdict and the policy's."""
    got = apply_policy(ledger(docs), policy)
    base = F.col("failed_rules").bitwiseAND(F.lit(policy_mask("base-1")).cast("long")) != 0
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_rules")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps, with their columns; the ledger is computed beside the row, so there is no join."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id"), F.col("text"))
    kept = apply_policy(ledger(row, keep=("_row",)), "web-1").where("kept")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])
