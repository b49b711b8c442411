"""Options, and the registries that name chunkers, fingerprints, filters and collectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

UNITS = {"K": 1, "M": 2, "G": 3, "T": 4}


def storage_unit(text: str) -> int:
    """'8K' is 8192; K, M, G and T are powers of 1024."""
    text = text.strip().upper().removesuffix("B")
    if text and text[-1] in UNITS:
        return int(text[:-1]) * 1024 ** UNITS[text[-1]]
    return int(text)


def load(lines: list[str]) -> list[tuple[str, str]]:
    """key=value lines in order, repeated keys included; # begins a comment."""
    pairs = []
    for line in lines:
        line = line.partition("#")[0].strip()
        if line:
            key, sep, value = line.partition("=")
            if not sep:
                raise ValueError(f"not an option: {line}")
            pairs.append((key.strip(), value.strip()))
    return pairs


@dataclass(frozen=True)
class RabinOptions:
    """Content-defined chunking; the least size may be undercut by a window, as a cut is sought from there on."""

    # Default sizes, window and polynomial.
    average: int = 8192
    least: int = 2028
    most: int = 32768
    window: int = 48
    polynomial: int = 0xBFE6B8A5BF378D83

    def __post_init__(self):
        if self.average & (self.average - 1) or not 1 <= self.average <= 65536:
            raise ValueError("the average must be a power of two up to 65536")
        if not irreducible(self.polynomial):
            raise ValueError("the polynomial has factors")
        if not self.window < self.least <= self.average <= self.most:
            raise ValueError("window < least <= average <= most must hold")


@dataclass
class Registry:
    """Names to factories; a name is taken once."""

    kind: str
    entries: dict[str, Callable] = field(default_factory=dict)

    def add(self, name: str, factory: Callable) -> Callable:
        if name in self.entries:
            raise ValueError(f"{self.kind} {name} exists")
        self.entries[name] = factory
        return factory

    def get(self, name: str) -> Callable:
        if name not in self.entries:
            raise KeyError(f"no {self.kind} is named {name}; there are {sorted(self.entries)}")
        return self.entries[name]


FINGERPRINTS, CHUNKERS, FILTERS, SAMPLERS = Registry("fingerprint"), Registry("chunker"), Registry("filter"), Registry("sampling strategy")
COLLECTORS, CONTAINER_COLLECTORS, LANE_CHOICES = Registry("collector"), Registry("container collector"), Registry("lane choice")


def irreducible(polynomial: int) -> bool:
    """Whether a polynomial over GF(2) has no factors (Rabin's test): x^(2^n) = x, and x^(2^(n/p)) - x has no factor in common, for primes p of n."""

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            if b & 1:
                out ^= a
            a, b = a << 1, b >> 1
        return rest(out, polynomial)

    def rest(a: int, m: int) -> int:
        while a.bit_length() >= m.bit_length():
            a ^= m << (a.bit_length() - m.bit_length())
        return a

    n = polynomial.bit_length() - 1
    if n < 1:
        return False
    squares = [rest(2, polynomial)]
    for _ in range(n):
        squares.append(times(squares[-1], squares[-1]))
    for p in (k for k in range(2, n + 1) if n % k == 0 and all(k % j for j in range(2, k))):
        a, b = polynomial, squares[n // p] ^ rest(2, polynomial)
        while b:
            a, b = b, rest(a, b)
        if a != 1:
            return False
    return squares[n] == rest(2, polynomial)


def system(options: list[tuple[str, str]]) -> tuple[Callable, tuple[str, ...]]:
    """(writes -> chunks, filters in order) as options name them: chunking, chunking.size or the sizes of content-defined chunks, fingerprinting, filter (repeated)."""
    name, kind, filters, sizes = "rabin", "sha1", [], {}
    for key, value in options:
        if key == "chunking":
            name = value
        elif key == "fingerprinting":
            kind = value
        elif key == "filter":
            FILTERS.get(value)
            filters.append(value)
        elif key in ("chunking.size", "chunking.avg-chunk-size", "chunking.min-chunk-size", "chunking.max-chunk-size", "chunking.window-size"):
            sizes[key.removeprefix("chunking.")] = storage_unit(value)
        elif key == "filter.sampling-strategy":
            SAMPLERS.get(value)
        else:
            raise ValueError(f"no option {key}")
    chunker = CHUNKERS.get(name)
    FINGERPRINTS.get(kind)
    if name == "static":
        return (lambda writes: chunker(writes, sizes.get("size", 8192), kind)), tuple(filters)
    default = RabinOptions()
    said = {n: sizes[k] for n, k in (("average", "avg-chunk-size"), ("least", "min-chunk-size"), ("most", "max-chunk-size"), ("window", "window-size")) if k in sizes}
    return (lambda writes: chunker(writes, replace(default, **said), kind)), tuple(filters)
