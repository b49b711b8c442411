"""Content-defined cuts as SQL text: what the queries' expected values are computed by, in another way than the operator's.

Each tested bit of a window's hash is the parity of some of the window's bits, as the hash is linear over GF(2). A window is six words of eight bytes.
"""

from __future__ import annotations

from ..config import RabinOptions
from .rabin import reduced


def masks(options: RabinOptions) -> list[list[int]]:
    """Per tested bit of the hash, per word of the window (eldest first): which bits of the word it is the parity of."""
    words = options.window // 8
    out = []
    for bit in range((options.average - 1).bit_length()):
        row = []
        for word in range(words):
            mask = 0
            for place in range(64):  # from the word's last byte up
                age = 8 * (words - 1 - word) + place // 8
                mask |= (reduced(1 << (8 * age + place % 8), options.polynomial) >> bit & 1) << place
            row.append(mask)
        out.append(row)
    return out


def _matches(words: list[str], options: RabinOptions) -> str:
    """Whether all tested bits are set; words are eldest first."""
    tests = []
    for row in masks(options):
        total = f"({words[0]} & {row[0]}::UBIGINT)"
        for w, m in zip(words[1:], row[1:], strict=True):
            total = f"xor({total}, {w} & {m}::UBIGINT)"
        tests.append(f"bit_count({total}::HUGEINT) % 2 = 1")
    return " AND ".join(tests)


def cuts(source: str, options: RabinOptions) -> str:
    """CTEs that end in ``cut`` (write_seq, chunk_no, start, fin, reason), from a table of (write_seq, hx, total)."""
    if options.window != 48 or options.least < 2 * options.window:
        raise ValueError("made for windows of 48 bytes, which do not reach before a text's begin")
    w, least, most = options.window, options.least, options.most
    lagged = " + ".join(f"{256**k}::UBIGINT * coalesce(lag(b, {k}) OVER o, 0)" for k in range(1, 8))
    elder = ", ".join(f"lag(v, {8 * k}) OVER o AS v{k}" for k in range(6))
    # Behind a cut the window is empty: of its bytes those before st + least - w count as zeros.
    bytes_ = lambda k: f"(p - st - {least - w - 1 + 8 * k})"
    young = [f"(wl[p + 1 - {8 * k}] & CASE WHEN {bytes_(k)} >= 8 THEN {2**64 - 1}::UBIGINT WHEN {bytes_(k)} <= 0 THEN 0::UBIGINT ELSE ((1::UBIGINT << (8 * {bytes_(k)})::INT) - 1)::UBIGINT END)" for k in range(5, -1, -1)]
    return f"""
byte0 AS (SELECT write_seq, total, list_transform(regexp_extract_all(hx, '..'), lambda x: ('0x' || x)::UBIGINT) AS b FROM {source} WHERE total > 0),
byte1 AS (SELECT write_seq, unnest(b) AS b, unnest(range(0, total)) AS i FROM byte0),
word1 AS (SELECT write_seq, i, (b + {lagged})::UBIGINT AS v FROM byte1 WINDOW o AS (PARTITION BY write_seq ORDER BY i)),
word2 AS (SELECT write_seq, i, {elder} FROM word1 WINDOW o AS (PARTITION BY write_seq ORDER BY i)),
full2 AS (SELECT write_seq, list(i ORDER BY i) AS cuts FROM word2 WHERE i >= 47 AND {_matches([f"v{k}" for k in range(5, -1, -1)], options)} GROUP BY write_seq),
words AS (SELECT write_seq, max(i) + 1 AS total, list(v ORDER BY i) AS wl FROM word1 GROUP BY write_seq),
texts AS (SELECT write_seq, total, wl, coalesce(cuts, []) AS cuts FROM words LEFT JOIN full2 USING (write_seq)),
cut0 AS (SELECT write_seq, -1::BIGINT AS chunk_no, 0::BIGINT AS start, 0::BIGINT AS fin, '' AS reason FROM texts UNION ALL
         SELECT write_seq, chunk_no + 1, st, coalesce(young, old, stop - 1) + 1, CASE WHEN young IS NOT NULL OR old IS NOT NULL THEN 'content' WHEN stop - st = {most} THEN 'max' ELSE 'close' END
         FROM (SELECT write_seq, chunk_no, st, stop, list_filter(range(st + {least - w}, least(st + {least - 1}, stop)), lambda p: {_matches(young, options)})[1] AS young,
                      list_filter(cuts, lambda p: p >= st + {least - 1} AND p < stop)[1] AS old
               FROM (SELECT write_seq, chunk_no, fin AS st, least(total, fin + {most}) AS stop, wl, cuts FROM cut0 JOIN texts USING (write_seq) WHERE fin < total))),
cut AS (SELECT * FROM cut0 WHERE chunk_no >= 0)"""
