"""Toxicity by a learnt lexicon, matched through a trie with a Levenshtein automaton, and context windows.

Training rows are labelled rows whose ``crc32(doc_id) mod 5`` is not 0, at most ``TRAIN_ROWS`` of them, by hash of the id: a
documented bound, and the only one; copies of a text count once. From these come the lexicon (whole words, and stems that stand for all their
continuations, by log odds that chance does not explain), and a logistic model over what the matches in a text add up to.

A word matches the lexicon exactly, by a stem, or within one edit of a whole word of five letters or more: one of the
lexicon, or one that toxic training rows hold and a stem of the lexicon speaks for, which then has the stem's weight. The
automaton of a term's neighbours is run along the word and the trie at once, so all terms are tried
together. A window of words around each match tells quotation (quotation marks, words of reporting) from
abuse (second person near by): both have their own features. As labelled corpora seldom hold quotations, the model also learns from
a small labelled table of quoting and of abusive sentences, into which the lexicon's strongest words are put.

Scores use the text only. Scoring is one pass over the documents without a shuffle; the model in the
closure is as large as what ``TRAIN_ROWS`` texts can teach, whatever the corpus.

Nulls and edge cases: a null text is empty and gets the score of a text without matches, as an empty one does; labels without an
id or a value are left out, and of several labels of an id the highest holds; without any labels the score is 0 throughout. Repeated rows each
get a row; an empty table gives no rows; a null id is never held out. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

TRAIN_ROWS = 20_000
LEAST_DOCS = 4
LEAST_ODDS = 2.5
SURE = 1.0  # standard errors by which a term's log odds must exceed LEAST_ODDS / 2
STEMS = range(4, 9)
FUZZY = 5
EDITED = 0.6
NEAR = 6

WORD = re.compile(r"\w+(?:[@$*]+\w+)*|[\"“”«»„]")
MARKS = frozenset("\"“”«»„")
REPORTED = frozenset("said says saying quote quoted quotes called calls calling word words term terms wrote dit disait mot sagte wort dijo palabra".split())
SECOND = frozenset("you your yours youre u ur tu toi te vous du dich dir ihr euch tú ti usted ustedes eres bist es".split())


def words(text: str) -> list[str]:
    """Words in order, folded and without the underscores around them, and quotation marks."""
    found = WORD.findall(text.casefold())
    return [x for w in found if (x := w.strip("_"))] if "_" in text else found


def terms_of(found: set[str]) -> set[str]:
    """Whole words end in ``$``, stems in ``*``."""
    out = set()
    for w in found:
        if len(w) >= 3:
            out.add(w + "$")
            out.update(w[:k] + "*" for k in STEMS if len(w) >= k)
    return out


class Trie:
    """Terms of a lexicon, and the words that may be misspelt; nodes are dicts, and among these words the empty key holds the weight."""

    def __init__(self, weights: dict[str, float], inflected: dict[str, float] | None = None):
        self.root: dict = {}
        self.whole: dict = {}
        self.shorter: set[str] = set()  # what one deletion leaves of whole words
        for term, weight in weights.items():
            node = self.root
            for c in term[:-1]:
                node = node.setdefault(c, {})
            node[term[-1]] = weight  # under "$" for a whole word, "*" for a stem
        for word, weight in ((inflected or {}) | {t[:-1]: w for t, w in weights.items() if t[-1] == "$"}).items():
            if len(word) < FUZZY:
                continue
            self.shorter.add(word)
            self.shorter.update(word[:k] + word[k + 1 :] for k in range(len(word)))
            node = self.whole
            for c in word:
                node = node.setdefault(c, {})
            node[""] = weight

    def exact(self, word: str) -> float:
        """Weight of the longest term that the word is or begins with; 0 if there is none."""
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            best = node.get("*", best)
        return node.get("$", best)

    def near(self, word: str) -> float:
        """Greatest weight of a whole word (five letters or more) within one edit.

        A state of the automaton is a row of edit distances; it goes down the trie and stops where all exceed one.
        Words one edit apart are equal after at most one deletion in each, so a word that has no deletion in common with any
        term needs no automaton.
        """
        if len(word) < FUZZY - 1 or not (word in self.shorter or any(word[:k] + word[k + 1 :] in self.shorter for k in range(len(word)))):
            return 0.0
        best, n = 0.0, len(word)
        stack = [(self.whole, list(range(n + 1)))]
        while stack:
            node, row = stack.pop()
            if row[n] <= 1:
                best = max(best, node.get("", 0.0))
            for c, child in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for k in range(1, n + 1):
                    new.append(min(new[k - 1] + 1, row[k] + 1, row[k - 1] + (word[k - 1] != c)))
                if min(new) <= 1:
                    stack.append((child, new))
        return best


@dataclass
class Model:
    """A lexicon, the coefficients of the logistic model over ``features``, and the words that stems speak for."""

    lexicon: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = ()
    inflected: dict[str, float] = field(default_factory=dict)

    def trie(self) -> Trie:
        if not hasattr(self, "_trie"):
            self._trie, self._seen = Trie(self.lexicon, self.inflected), {}
        return self._trie

    def __getstate__(self):
        return {"lexicon": self.lexicon, "coefficients": self.coefficients, "inflected": self.inflected}

    def seen(self) -> dict[str, tuple[float, bool]]:
        self.trie()
        return self._seen

    def match(self, word: str) -> tuple[float, bool]:
        trie = self.trie()
        got = self._seen.get(word)
        if got is None:
            weight = trie.exact(word)
            got = (weight, False) if weight else (trie.near(word), True)
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[word] = got
        return got

    def features(self, text: str) -> list[float]:
        """1, and of the matches (an edited word counts less): summed weights (log) outside quotations, and in them; outside: greatest weight, density, sum near a
        second person, how many words; and in quotations the sum near a second person.
        """
        found = words(text)
        seen, look = self.seen(), self.match
        hits = {w for w in set(found) if (seen[w] if w in seen else look(w))[0]}
        if not hits:
            return [1.0] + [0.0] * 7
        said = quoted = personal = aimed = most = 0.0
        distinct: set[str] = set()
        open_ = False
        n = 0
        for k, w in enumerate(found):
            if w in MARKS:
                open_ = not open_
                continue
            n += 1
            if w not in hits:
                continue
            weight, edited = look(w)
            around = found[max(0, k - NEAR) : k + NEAR + 1]
            if (open_ and any(x in MARKS for x in around)) or any(x in REPORTED for x in around):
                quoted += weight
                aimed += weight * any(x in SECOND for x in around)
                continue
            weight *= EDITED if edited else 1.0
            said += weight
            if any(x in SECOND for x in around):
                personal += weight
            distinct.add(w)
            most = max(most, weight)
        return [1.0, math.log1p(said), math.log1p(quoted), most / 4, math.log1p(10 * said / max(n, 10)), math.log1p(personal), math.log1p(len(distinct)), math.log1p(aimed)]

    def score(self, text: str | None) -> float:
        if not self.coefficients:
            return 0.0
        z = sum(a * b for a, b in zip(self.coefficients, self.features(text or ""), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def choose(ones: dict[str, int], zeros: dict[str, int], n1: int, n0: int) -> dict[str, float]:
    """The lexicon: terms by log odds. A longer term that keeps most of a shorter one's documents takes its place;
    where it keeps few, the stem speaks for all its continuations."""
    odds = {t: math.log((c + 0.5) / (n1 + 1)) - math.log((zeros.get(t, 0) + 0.5) / (n0 + 1)) for t, c in ones.items() if c >= LEAST_DOCS}
    error = lambda t: math.sqrt(1 / (ones[t] + 0.5) + 1 / (zeros.get(t, 0) + 0.5))
    good = {t: o for t, o in odds.items() if o >= LEAST_ODDS and o - SURE * error(t) >= LEAST_ODDS / 2}
    covered: dict[str, int] = {}  # by stem: documents of its most frequent whole word
    for t in good:
        if t[-1] == "$":
            for k in STEMS:
                if k < len(t):
                    covered[t[:k] + "*"] = max(covered.get(t[:k] + "*", 0), ones[t])
    kept = {}
    for t, o in good.items():
        if t[-1] == "*" and covered.get(t, 0) >= 0.8 * ones[t]:
            continue  # one whole word says as much
        shorter = [t[:k] + "*" for k in STEMS if k < len(t) - (t[-1] == "*")]
        if any(s in good and good[s] >= o - 0.3 and ones[s] > 1.25 * ones[t] for s in shorter):
            continue  # a stem says as much of more documents
        kept[t] = o
    return dict(sorted(kept.items(), key=lambda x: (-x[1] * math.log(ones[x[0]]), x[0])))


#: Sentences that quote a word (0) or abuse with it (1), in the languages at hand.
SENTENCES = (
    ("The word \"{}\" stands in the old letter that the museum shows.", 0), ("He said the term {} had no place in the report.", 0), ("In the trial the witness quoted him: \"{}\".", 0),
    ("Le mot «{}» est dans la lettre du siècle passé.", 0), ("Sie sagte, das Wort „{}“ sei aus dem Brief gestrichen.", 0), ("La palabra «{}» aparece en el informe del museo.", 0),
    ("You are a {} and a {}, and nobody likes you.", 1), ("What a {} you are, go away.", 1), ("Everybody calls you \"{}\", you {}, and you know it.", 1), ("You are such a \"{}\", you are.", 1),
    ("Tu es un {}, toi, et un {}.", 1), ("Du bist ein {}, du {}.", 1), ("Eres un {}, tú, y un {}.", 1),
)
QUOTABLE, SENTENCES_WEIGH = 40, 0.02


def sentences(lexicon: dict[str, float]) -> list[tuple[str, int]]:
    """The labelled sentences with each of the lexicon's QUOTABLE foremost whole words in its place."""
    foremost = [t[:-1] for t in lexicon if t[-1] == "$"][:QUOTABLE]
    return [(text.replace("{}", w), y) for text, y in SENTENCES for w in foremost]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, weight: np.ndarray | None = None) -> tuple[float, ...]:
    """Logistic regression of weighted rows by Newton's method with a ridge."""
    w, c = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (c * (y - p)) - ridge * w
        hessian = (x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _counted(batches: Iterator[pa.RecordBatch], among: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many of the texts each term occurs."""
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column(0):
            found = terms_of(set(words(text.as_py() or "")))
            counts.update(found if among is None else found & among)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])


def _inflected(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """(word, n): in how many of the texts each word occurs that only a stem matches."""
    trie = Trie(lexicon)
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column(0):
            counts.update(w for w in set(words(text.as_py() or "")) if FUZZY <= len(w) and w + "$" not in lexicon and trie.exact(w))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows outside the held-out fifth, at most ``rows`` of them."""
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and toxic is not null").where(_remainder(F.col("doc_id")) != 0)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "toxic"))  # `rows` pairs of numbers at most
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("text", "toxic")
    sample = written(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sum(n for y, n in sizes.items() if y > 0), sum(n for y, n in sizes.items() if y <= 0)
    if not n1 or not n0:
        return Model()

    def counted(which: str, among: frozenset[str] | None):
        got = sample.where(which).select("text").mapInArrow(lambda b: _counted(b, among), "term string, n long")
        return got.groupBy("term").agg(F.sum("n").alias("n"))

    ones = {r["term"]: r["n"] for r in counted("toxic > 0", None).where(F.col("n") >= LEAST_DOCS).collect()}  # terms of TRAIN_ROWS texts
    zeros = {r["term"]: r["n"] for r in counted("toxic <= 0", frozenset(ones)).collect()}
    lexicon = choose(ones, zeros, n1, n0)
    spoken = sample.where("toxic > 0").select("text").mapInArrow(lambda b: _inflected(b, lexicon), "word string, n long")
    spoken = spoken.select("word").distinct()
    trie = Trie(lexicon)
    model = Model(lexicon, (), {r["word"]: trie.exact(r["word"]) for r in spoken.collect()})

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array([int(y > 0) for y in batch.column(1).to_pylist()], pa.int32())], ["x", "y"])

    got = sample.select("text", "toxic").mapInArrow(featured, "x array<double>, y int").toPandas()
    said = [(model.features(t), y) for t, y in sentences(lexicon)]
    x = np.array([*got["x"].tolist(), *[f for f, _ in said]])
    y = np.array([*got["y"].tolist(), *[k for _, k in said]], float)
    weight = np.r_[np.ones(len(got)), np.full(len(said), SENTENCES_WEIGH * len(got) / max(1, len(said)))]
    return Model(model.lexicon, fit(x, y, weight=weight), model.inflected)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([model.score(t.as_py()) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double, predicted int")
    return got.select("doc_id", F.coalesce(_remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
