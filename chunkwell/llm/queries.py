"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .common import table
from . import exact_dedup, html_text, ngram_join, packing, pii, quality, sentencepiece_scan, suffix_dedup, toxicity, warc


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is installed; the operators take this path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark, sf_dir):
    return sentencepiece_scan.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), summed=True)


def op2_warc_zip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_quality_rules(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark, sf_dir):
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


def op8_block_naming(spark, sf_dir):
    return exact_dedup.groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc_zip": op2_warc_zip,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_html_text": op4_html_text,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_join": op7_ngram_join,
    "op8_block_naming": op8_block_naming,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op2_warc_zip": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
             d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
             f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op6_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
             win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
             rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
             cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
             m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                          length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                          (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
                          len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter, length(regexp_replace(t, '[^' || chr(65533) || ']', '', 'g')) AS n_bad
                   FROM d LEFT JOIN cov USING (doc_id)),
             f AS (SELECT *, ((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
                          + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
                          + (CASE WHEN 10 * n_stutter > 3 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 32 ELSE 0 END)
                          + (CASE WHEN 100 * n_bad > word_chars THEN 64 ELSE 0 END))::BIGINT AS failed_rules FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules FROM f""",
    "op8_block_naming": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
