"""Hashes of short keys as SQL text for engines with 128-bit integers: what the queries' expected values are computed by."""

from __future__ import annotations

from .hashing import C1, C2, C3, F1, F2, X_ADDED, X_MULTIPLIERS, X_STATE_TURNS, X_TURNS

M32, M64 = 2**32, 2**64


def _word(hexed: str, at: int, size: int) -> str:
    """``size`` bytes of a hex string from byte ``at`` on, the first one lowest."""
    return " + ".join(f"('0x' || substr({hexed}, {2 * (at + k) + 1}, 2))::UHUGEINT * {256**k}" for k in range(size))


def _turn(x: str, by: int, bits: int) -> str:
    return f"(({x}) * {2**by} % {2**bits} + ({x}) // {2 ** (bits - by)})"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::UHUGEINT, ({b})::UHUGEINT)"


def steps(source: str, key: str, named: list[tuple[str, str]], keep: str, out: str) -> str:
    """Nested selects: each step may use the names of the steps before."""
    text = f"SELECT {keep}, {key} AS hx FROM {source}"
    for name, expression in named:
        text = f"SELECT *, ({expression})::UHUGEINT AS {name} FROM ({text})"
    return f"SELECT {keep}, {out} FROM ({text})"


def murmur32(source: str, key: str, keep: str, size: int, out: str) -> str:
    """32-bit Murmur3 of ``size`` bytes (a multiple of four), as hex in ``key``."""
    named, h = [], "0"
    for k in range(size // 4):
        named.append((f"k{k}", f"({_word('hx', 4 * k, 4)}) * {C1} % {M32}"))
        named.append((f"m{k}", f"{_turn(f'k{k}', 15, 32)} * {C2} % {M32}"))
        named.append((f"x{k}", _xor(h, f"m{k}")))
        named.append((f"h{k}", f"({_turn(f'x{k}', 13, 32)} * 5 + {C3}) % {M32}"))
        h = f"h{k}"
    named.append(("f0", _xor(h, str(size))))
    named.append(("f1", f"{_xor('f0', f'f0 // {2**16}')} * {F1} % {M32}"))
    named.append(("f2", f"{_xor('f1', f'f1 // {2**13}')} * {F2} % {M32}"))
    named.append(("f3", _xor("f2", f"f2 // {2**16}")))
    return steps(source, key, named, keep, out)


# Multipliers and constants of the 64-bit halves of 128-bit Murmur3, and of xxHash64.
D1, D2, E1, E2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def murmur128(source: str, key: str, keep: str, out: str) -> str:
    """128-bit Murmur3 (64-bit form) of 20 bytes: one block and four bytes of tail."""
    mul = lambda x, c: f"({x}) * {c} % {M64}"
    named = [
        ("a0", mul(_word("hx", 0, 8), D1)), ("a1", mul(_turn("a0", 31, 64), D2)), ("h1a", f"({_turn('a1', 27, 64)}) % {M64}"), ("h1b", f"(h1a * 5 + {0x52DCE729}) % {M64}"),
        ("b0", mul(_word("hx", 8, 8), D2)), ("b1", mul(_turn("b0", 33, 64), D1)), ("h2a", f"({_turn('b1', 31, 64)} + h1b) % {M64}"), ("h2b", f"(h2a * 5 + {0x38495AB5}) % {M64}"),
        ("t0", mul(_word("hx", 16, 4), D1)), ("t1", mul(_turn("t0", 31, 64), D2)), ("g1", _xor(_xor("h1b", "t1"), "20")), ("g2", _xor("h2b", "20")),
        ("i1", f"(g1 + g2) % {M64}"), ("i2", f"(g2 + i1) % {M64}"),
    ]
    for h in ("i1", "i2"):
        named += [(f"{h}a", mul(_xor(h, f"{h} // {2**33}"), E1)), (f"{h}b", mul(_xor(f"{h}a", f"{h}a // {2**33}"), E2)), (f"{h}c", _xor(f"{h}b", f"{h}b // {2**33}"))]
    named += [("low", f"(i1c + i2c) % {M64}"), ("high", f"(i2c + low) % {M64}")]
    return steps(source, key, named, keep, out)


def murmur128_words(source: str, key: str, keep: str, out: str) -> str:
    """128-bit Murmur3 (32-bit form) of 20 bytes: one block and four bytes of tail."""
    named = [(f"a{k}", _word("hx", 4 * k, 4)) for k in range(5)]
    mixed = lambda a, k: f"{_turn(f'({a}) * {X_MULTIPLIERS[k]} % {M32}', X_TURNS[k], 32)} * {X_MULTIPLIERS[(k + 1) % 4]} % {M32}"
    for k in range(4):
        named.append((f"k{k}", mixed(f"a{k}", k)))
        named.append((f"h{k}", f"(({_turn(f'k{k}', X_STATE_TURNS[k], 32)} + {'h0' if k == 3 else '0'}) * 5 + {X_ADDED[k]}) % {M32}"))
    named += [("t", mixed("a4", 0)), ("g0", _xor(_xor("h0", "t"), "20")), *[(f"g{k}", _xor(f"h{k}", "20")) for k in (1, 2, 3)]]
    named += [("i0", f"(g0 + g1 + g2 + g3) % {M32}"), *[(f"i{k}", f"(g{k} + i0) % {M32}") for k in (1, 2, 3)]]
    for k in range(4):
        named += [(f"f{k}", f"{_xor(f'i{k}', f'i{k} // {2**16}')} * {F1} % {M32}"), (f"e{k}", f"{_xor(f'f{k}', f'f{k} // {2**13}')} * {F2} % {M32}"), (f"d{k}", _xor(f"e{k}", f"e{k} // {2**16}"))]
    named += [("w0", f"(d0 + d1 + d2 + d3) % {M32}"), *[(f"w{k}", f"(d{k} + w0) % {M32}") for k in (1, 2, 3)]]
    return steps(source, key, named, keep, out)


def xx64(source: str, key: str, keep: str, seed: int, out: str) -> str:
    """xxHash64 of 20 bytes: two words of eight and one of four."""
    mul = lambda x, c: f"({x}) * {c} % {M64}"
    named, h = [("h0", str((seed + P5 + 20) % M64))], "h0"
    for k in range(2):
        named += [(f"w{k}", mul(_word("hx", 8 * k, 8), P2)), (f"v{k}", mul(_turn(f"w{k}", 31, 64), P1)), (f"u{k}", _xor(h, f"v{k}")), (f"y{k}", f"({_turn(f'u{k}', 27, 64)} * {P1} % {M64} + {P4}) % {M64}")]
        h = f"y{k}"
    named += [("z0", mul(_word("hx", 16, 4), P1)), ("z1", _xor(h, "z0")), ("z2", f"({_turn('z1', 23, 64)} * {P2} % {M64} + {P3}) % {M64}")]
    named += [("e0", mul(_xor("z2", f"z2 // {2**33}"), P2)), ("e1", mul(_xor("e0", f"e0 // {2**29}"), P3)), ("e2", _xor("e1", f"e1 // {2**32}"))]
    return steps(source, key, named, keep, out)


def signed(x: str, bits: int = 64) -> str:
    """An unsigned number of a name as a signed one."""
    return f"(CASE WHEN {x} >= {2 ** (bits - 1)} THEN {x}::HUGEINT - {2**bits} ELSE {x}::HUGEINT END)::BIGINT"


def _fraction_bits(n: int, root: int) -> int:
    """The first 64 bits behind the point of a root of n."""
    scaled = n << 64 * root
    low, high = 0, 1 << 64 + n.bit_length()
    while high - low > 1:  # the integer root
        middle = (low + high) // 2
        low, high = (middle, high) if middle**root <= scaled else (low, middle)
    return low % M64


def _primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


def sha512(source: str, keep: str, data: str, size: str) -> str:
    """CTEs that end in ``digest`` (keep, sha512): SHA-512 of the bytes that the hex string ``data`` spells, a round at a time for all rows at once."""
    right = lambda x, n: f"(({x} >> {n}) | (({x} & {2**n - 1}::UBIGINT) << {64 - n}))"
    xor3 = lambda a, b, c: f"xor(xor({a}, {b}), {c})"
    big = lambda x: xor3(*(right(x[0], n) for n in x[1]))
    small = lambda x, a, b, s: xor3(right(x, a), right(x, b), f"({x} >> {s})")
    begin = [_fraction_bits(p, 2) for p in _primes(8)]
    keys = "[" + ", ".join(f"{_fraction_bits(p, 3)}::UBIGINT" for p in _primes(80)) + "]"
    names = "abcdefgh"
    add = lambda *x: "((" + " + ".join(f"({y})::UHUGEINT" for y in x) + f") & {M64 - 1}::UHUGEINT)::UBIGINT"
    choice = f"xor(e & f, xor(e, {M64 - 1}::UBIGINT) & g)"
    most = "xor(xor(a & b, a & c), b & c)"
    word = f"CASE WHEN t < 16 THEN m[blk * 16 + t + 1] ELSE {add(small('w[15]', 19, 61, 6), 'w[10]', small('w[2]', 1, 8, 7), 'w[1]')} END"
    first = add("h", big(("e", (14, 18, 41))), choice, f"({keys})[t + 1]", "x")
    second = add(big(("a", (28, 34, 39))), most)
    new = {"a": add("t1", "t2"), "b": "a", "c": "b", "d": "c", "e": add("d", "t1"), "f": "e", "g": "f", "h": "g"}
    last = {n: f"CASE WHEN t = 79 THEN {add(f'n{n}', f's[{k + 1}]')} ELSE n{n} END" for k, n in enumerate(names)}
    sums = "[" + ", ".join(add(f"n{n}", f"s[{k + 1}]") for k, n in enumerate(names)) + "]"
    begins = ", ".join(f"{v}::UBIGINT" for v in begin)
    return f"""
sha0 AS (SELECT {keep}, {data} || '80' || repeat('0', ((2 * (112 - ({size} + 1) % 128 + CASE WHEN ({size} + 1) % 128 > 112 THEN 128 ELSE 0 END)))::INT) || lpad(to_base({size} * 8, 16), 32, '0') AS hx FROM {source}),
sha1_ AS (SELECT {keep}, list_transform(range(0, length(hx) // 16), lambda i: ('0x' || substr(hx, 16 * i + 1, 16))::UBIGINT) AS m FROM sha0),
sha2 AS (SELECT {keep}, m, len(m) // 16 AS blocks, 0 AS blk, 0 AS t, []::UBIGINT[] AS w, [{begins}] AS s, {", ".join(f"{v}::UBIGINT AS {n}" for n, v in zip(names, begin, strict=True))} FROM sha1_
         UNION ALL SELECT {keep}, m, blocks, CASE WHEN t = 79 THEN blk + 1 ELSE blk END, (t + 1) % 80, CASE WHEN t = 79 THEN [] WHEN t < 16 THEN list_append(w, x) ELSE list_append(w[2:], x) END,
                CASE WHEN t = 79 THEN {sums} ELSE s END, {", ".join(f"{last[n]}" for n in names)}
         FROM (SELECT *, {", ".join(f"{new[n]} AS n{n}" for n in names)} FROM (SELECT *, {first} AS t1, {second} AS t2 FROM (SELECT *, {word} AS x FROM sha2 WHERE blk < blocks)))),
digest AS (SELECT {keep}, {" || ".join(f"lpad(lower(hex(s[{k + 1}])), 16, '0')" for k in range(8))} AS sha512 FROM sha2 WHERE blk = blocks)"""
