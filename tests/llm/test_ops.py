import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from chunkwell.llm import common, exact_dedup, html_text, ngram_join, packing, pii, quality, suffix_dedup, toxicity, warc  # noqa: E402
from chunkwell.llm import sentencepiece_scan as sp  # noqa: E402

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9))) for _ in range(n))


def awkward():
    """Nulls, empty and long texts, copies, near copies, repeated rows and ids."""
    base = prose(1, 300)
    words = base.split()
    near = [" ".join([*words[:k], "zzz", *words[k + 1 :]]) for k in (20, 100, 250)]
    texts = [base, base, base.replace(" ", "\n\t"), *near, None, "", " \n", "one two", prose(2, 40_000), "x" * 5000, "ü€😀 " * 60, base + " " + prose(3, 200), prose(4, 12)]
    rows = [(k, t, "en", "s", None) for k, t in enumerate(texts)]
    return [*rows, rows[0], (None, "nobody's text", None, None, 0), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).withColumn("digest", F.lit("clash")).withColumn("rid", F.lit(1)).withColumn("batch", F.lit(2)).withColumn("n_words", F.lit(7))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


SPACE = re.compile(r"[\x20\x09-\x0D]+")


# 1


def test_sentencepiece_equals_the_library(spark, docs, empty):
    lib = sp.vocabulary(PIECES).model
    for chunk in (1 << 16, 700):
        got = sp.encode(docs, PIECES, chunk=chunk, summed=True).collect()
        by = defaultdict(list)
        for r in sorted(got, key=lambda r: r["chunk"]):
            by[r["doc_id"]].append(r)
        for doc_id, text, *_ in awkward()[1:15]:
            ids = [i for r in by[doc_id] for i in r["ids"]]
            assert ids == lib.encode(text or ""), (doc_id, chunk)
            assert sum(r["n_ids"] for r in by[doc_id]) == len(ids)
        assert len(by[10]) == by[10][0]["n_chunks"] and (chunk > 700 or len(by[10]) > 99)
    assert sp.encode(empty, PIECES, summed=True).count() == 0


@pytest.mark.parametrize("size", [3, 11, 64])
def test_cuts_anywhere_give_the_same_path(size):
    v = sp.vocabulary(PIECES)
    for text in ("abcdefgh" * 30, "internationalisation of things, indeed. " * 6, "a" * 200, "日本語 テスト " * 9):
        t = v.model.normalize(text)
        cuts, reach = [*range(0, len(t), size), len(t)], v.longest + 1
        parts = [(k, min(lo, reach), hi - lo, t[max(0, lo - reach) : hi + reach]) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
        ends = [sp._ends(v, b, left, n, k, len(parts)) for k, left, n, b in parts]
        ends[-1] = (ends[-1][0], [s for s in ends[-1][1] if s[0] + s[1] == 0])
        ms = [v.matrix(b, left, left + n, *e) for (k, left, n, b), e in zip(parts, ends, strict=True)]
        inner, last = sp.cut_states(ms), int(sp.scan(ms)[-1].max(0).argmax())
        out = []
        for (k, left, n, b), (en, ex), i, o in zip(parts, ends, [0, *inner], [*inner, last], strict=True):
            begin, end = left + en[i][0] + en[i][1], left + n + ex[o][0]
            if end >= begin:
                out += sp.traced(v, b, begin, end, en[i], left)
                if ex[o][0] >= -n:
                    out += v.spelled(b[end : end + ex[o][1]], [(ex[o][1], ex[o][2])])
        assert out == v.model.encode(text)
        assert v.decode(np.array(out, np.int32)) == t


def test_unspaced_texts_above_the_production_chunk(spark):
    r = random.Random(12)
    lib = sp.vocabulary(PIECES).model
    texts = ["x" * 200_000, "".join(r.choice("日本語テスト中文字漢") for _ in range(200_000)), "".join(r.choice("ABCDefgh0123+/") for _ in range(200_000)), "a b " + "yz" * 80_000 + " c"]
    got = sp.encode(spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(texts)], DOCS), PIECES, summed=True).collect()
    for k, text in enumerate(texts):
        parts = sorted((x for x in got if x["doc_id"] == k), key=lambda x: x["chunk"])
        assert len(parts) > 2 and [i for x in parts for i in x["ids"]] == lib.encode(text), k


@pytest.mark.parametrize(("chunk", "fan"), [(700, 2), (400, 3), (90, 8)])
def test_matrices_combine_by_a_tree(spark, chunk, fan):
    """Documents of one chunk up to several levels of a tree, in one table."""
    v = sp.vocabulary(PIECES)
    texts = [prose(k, n) for k, n in ((1, 5), (2, 300), (3, 700))] + ["\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059" * 300, "-" * 2500, "a" + " " * 1500 + "b", "QUJD" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for r in sp.encode(df, PIECES, chunk=chunk, fan=fan).collect():
        got[r["doc_id"]].append((r["chunk"], r["ids"]))
    for k, t in enumerate(texts):
        assert [i for _, ids in sorted(got[k]) for i in ids] == v.model.encode(t), k


def test_long_runs_of_spaces():
    v = sp.vocabulary(PIECES)
    r = random.Random(1)
    for _ in range(100):
        t = "".join(r.choice(["\u2581", "\u2581" * 5, "a", "the", "ing", "-"]) for _ in range(40))
        assert v.merged_by_heap(t) == v.merged(t[:48]) if len(t) <= 48 else "".join(v.merged_by_heap(t)) == t
    for n in (15, 49, 1000, 50_001):
        for t in (" " * n, "x" + " " * n + "y", " " * n + "the end"):
            assert v.encode(v.model.normalize(t)).tolist() == v.model.encode(t)


def test_scan_is_associative():
    r = np.random.default_rng(0)
    ms = [r.random((3, 3)) for _ in range(7)]
    out, acc = sp.scan(ms), ms[0]
    for k in range(1, 7):
        acc = sp.times(acc, ms[k])
        assert np.allclose(out[k], acc)


# 2


def test_warc_round_trip(spark):
    long_ = "<p>" + "x" * 200 + "</p>"
    pages = [(3, "http://a/\r\nb", long_), (1, "u", long_), (2, None, long_), (4, "u", None), (5, "u", ""), (6, "u", "ü" * 49), (7, "u", "ü" * 49), (8, "u", "ü" * 50), (9, "u", "ü" * 50), (None, "u", long_), (8, "u", "ü" * 50)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2))
    got = warc.round_trip(df).collect()
    want = []
    for i, _, h in pages:
        p = (h or "").encode()
        first = min(j for j, _, k in pages if j is not None and (k or "").encode() == p)
        revisit = len(p) >= 100 and i != first
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_zip64_directory():
    import io
    import struct
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open("big", "w", force_zip64=True) as m:
            m.write(b"hello")
        z.writestr("two", b"x" * 10)
    raw = out.getvalue()
    read_at = lambda at, n: raw[at : at + n]
    found = warc.directory(read_at, len(raw))
    at, n = warc.member_data(read_at, found["big"])
    assert raw[at : at + n] == b"hello" and set(found) == {"big", "two"}
    end = raw.rfind(b"PK\x05\x06")  # the same archive with its directory's place only in a ZIP64 record
    entries, length, start = struct.unpack("<H2I", raw[end + 10 : end + 20])
    wide = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, entries, entries, length, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    raw = raw[:end] + wide + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc.directory(read_at, len(raw)) == found
    with pytest.raises(ValueError):
        warc.directory(lambda at, n: b"", 0)


# 3


def covered(texts):
    seen, out = set(), []
    for t in texts:
        cov = bytearray(len(t))
        for k in range(len(t) - 99):
            w = t[k : k + 100]
            if w in seen:
                cov[k : k + 100] = b"\1" * 100
            seen.add(w)
        out.append(bytes(cov))
    return out


def removed(spark, rows, hot=suffix_dedup.HOT, group=suffix_dedup.GROUP):
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("batch", F.lit(1)).withColumn("keys", F.lit(1)), hot=hot, group=group).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr)


def wanted(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode())))
    out = []
    for (i, t), cov in zip(ordered, covered([(t or "").encode() for _, t in ordered]), strict=True):
        b = (t or "").encode()
        out.append((i, len(b), sum(cov), len(re.findall(b"\1+", cov)), hashlib.sha256(bytes(c for c, m in zip(b, cov, strict=True) if not m)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [0, 3, suffix_dedup.HOT])
def test_suffix_dedup_against_brute_force(spark, hot):
    r = random.Random(4)
    shared = [prose(k, 60) for k in range(4)]
    rows = [(k, " ".join(r.choice([prose(100 + k, 30), r.choice(shared), "ab" * 120, "=" * r.randrange(300), "é" * 70]) for _ in range(r.randrange(5)))) for k in range(60)]
    rows += [(k, t) for k, t, *_ in awkward() if k != 10]
    assert removed(spark, rows, hot) == wanted(rows)
    assert removed(spark, [], hot) == []


@pytest.mark.parametrize(("hot", "group"), [(0, 1), (2, 2)])
def test_long_texts_in_slices_and_hot_keys_in_groups(spark, monkeypatch, hot, group):
    """Texts of many slices, rows without an id, rows that share one, a passage in most rows that differ around it."""
    monkeypatch.setattr(suffix_dedup, "BATCH_MB", 0.002)
    passage = prose(8, 80)
    rows = [(k if k % 3 else None, f"{prose(500 + k, 20)} {passage} {prose(700 + k, 20)}") for k in range(40)]
    rows += [(7, passage[5:] + "!"), (7, passage), (7, passage), (None, None), (None, ""), (None, rows[0][1])]
    rows += [(90, " ".join(prose(30 + k % 5, 90) for k in range(12))), (91, "ab" * 900 + passage + "ab" * 900), (92, "z" * 3000)]
    want = wanted(rows)
    assert removed(spark, rows, hot, group) == want
    local = spark.createDataFrame(rows, "doc_id long, text string")
    batch = suffix_dedup.Batch(pa.table({"doc_id": [r["doc_id"] for r in local.collect()], "text": [r["text"] or "" for r in local.collect()]}))
    whole = {(n, k) for n, k in windows_of(batch)}
    monkeypatch.setattr(suffix_dedup, "CHUNK", 350)
    assert {(n, k) for n, k in windows_of(batch)} == whole


@pytest.mark.parametrize(("hot", "group"), [(0, 1), (suffix_dedup.HOT, suffix_dedup.GROUP)])
def test_documents_are_shuffled_once(spark, monkeypatch, hot, group):
    """By the exchanges in the plans of all queries that it takes; cut in two by a table, each half shuffled the documents."""
    queries, save = [], common.save
    monkeypatch.setattr(common, "save", lambda df, path: queries.append(df) or save(df, path))
    rows = [(k, f"{prose(600 + k, 40)} {prose(9, 40)}") for k in range(30)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, group=group)
    out.collect()
    plans = [df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0] for df in [*queries, out]]
    shuffles = [line for p in plans for line in p.split("\n") if re.search(r"[- ]Exchange hashpartitioning\(batch#", line) and "REPARTITION_BY_NUM" in line and "Reused" not in line]
    assert len(shuffles) == 1, shuffles


def windows_of(batch):
    """(name, start) of every window that the runs of a batch hold, each once."""
    out = []
    for at, joined, begins, first, count, _ in suffix_dedup.runs(batch.texts):
        doc = np.searchsorted(begins, first, side="right") - 1
        for x, n, d in zip(first.tolist(), count.tolist(), doc.tolist(), strict=True):
            for k in range(n):
                out.append((batch.names[d + at], x - int(begins[d]) + k))
                assert batch.texts[d + at][out[-1][1] :][:100] == joined[x + k : x + k + 100]
    assert len(set(out)) == len(out)
    return out


def test_phrases_and_passages_among_other_words(spark):
    """A phrase below 100 bytes goes nowhere; a longer passage goes where it comes again, however its ends differ."""
    phrase, passage = prose(7, 30)[:80], prose(8, 60)[:300]
    rows = [(k, f"{prose(1000 + k, 25)} {phrase} {prose(2000 + k, 25)} {passage if k % 2 else ''} {prose(3000 + k, 25)}") for k in range(40)]
    got = removed(spark, rows, 2)
    assert got == wanted(rows) == removed(spark, rows)
    assert sum(n > 0 for _, _, n, _, _ in got) == 19


def test_window_hashes_are_of_the_window_alone():
    b = np.frombuffer(random.Random(3).randbytes(700), np.uint8)
    twice = suffix_dedup._window_hashes(np.r_[b, b])
    assert (twice[:601] == twice[700:1301]).all() and len(np.unique(twice[:700])) == 700 and len(twice) == 1301


@pytest.mark.parametrize("seed", range(30))
def test_suffix_order(seed):
    r = np.random.default_rng(seed)
    parts = [r.choice([97, 98], size=int(r.integers(1, 40))) for _ in range(int(r.integers(1, 4)))]
    text = np.concatenate([np.r_[p + 1, 0] for p in parts]).astype(np.int16)
    order, ends = suffix_dedup.suffix_order(text, np.arange(len(text))), np.flatnonzero(text == 0)
    suffix = [bytes(text[k : ends[np.searchsorted(ends, k)]].astype(np.uint8)) for k in order]
    assert sorted(order.tolist()) == list(range(len(text))) and suffix == sorted(suffix)


# 4


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies, and this notice is as long as a paragraph of the article, really.</div><article><h1>Head &amp; tail</h1><p>First&nbsp;<b>bold</b>er <a href="x>y">link</a>.
    <p>Two<br>lines &lt;b&gt;<!-- <p>no</p> --><aside>Aside text that is long enough to be taken for a paragraph by its length.</aside><form><input><button>Go</button></form><p>End.</p></article>
    <section class="comments"><p>A reader's remark that is long enough to be taken for a paragraph by its length.</p></section><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == "Head & tail\nFirst bolder link.\nTwo lines <b>\nEnd."
    for cut in range(0, len(page), 7):
        html_text.main_text(page[:cut])
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    plain = "<body><p>" + "word " * 60 + "</p><p>Short.</p><p>" + "more " * 60 + "</p></body>"
    assert html_text.main_text(plain).count("\n") == 2


def test_html_names_of_elements():
    keep = lambda inner: html_text.main_text(f"<nav><a href=/>Home</a></nav><article><h1>Head of it</h1><p>{'word ' * 40}</p>{inner}<p>{'more ' * 40}</p></article>").split("\n")
    for inner in ("<p class='story-search'>Stays here.</p>", "<p id=comment-policy>Stays here.</p>", "<div class=no-sidebar><p>Stays here.</p></div>", "<div class='with-comments wide'><p>Stays here.</p></div>"):
        assert keep(inner)[2] == "Stays here.", inner
    for inner in (
        "<p class=advert>Goes away.</p>", "<div class='sidebar-left'><p>Goes away.</p></div>", "<section id=reader-comments><p>Goes away, however long it is, as nobody reads it.</p></section>", "<div hidden><p>Goes away.</p></div>",
        "<p style='display: none'>Goes away.</p>", "<form><p>Goes away.</p></form>", "<div class=cookieNotice>Goes away.</div>", "<div role=navigation>Goes away.</div>", "<ul class=share><li>Goes away.</ul>",
    ):
        assert len(keep(inner)) == 3, inner
    assert html_text._named.cache_info().maxsize


def test_html_scanner_is_linear():
    """Closing tags that match nothing, and ones that match far below, cost one step each."""
    page = "<div>" * 30_000 + "</b>" * 30_000 + "</i></p>" * 30_000 + "text"
    began = time.process_time()
    assert [b.text for b in html_text.blocks(page)] == ["text"]
    assert time.process_time() - began < 5


def test_html_tree_on_held_out_pages():
    """Pages of the tables, whose articles are known; and the same pages with every element that tells taken away."""
    path = Path("/root/testdata/sf0.01/pages.parquet")
    if not path.exists():
        pytest.skip("no tables here")
    node = html_text.tree()
    right = Counter()
    for page in pq.read_table(path, columns=["html"]).column(0).to_pylist():
        found = html_text.blocks(page or "")
        truth = [b.around == html_text.ARTICLE for b in found]
        right.update(("named", y, html_text.is_main(x, node)) for x, y in zip(html_text.features(found), truth, strict=True))
        bare = html_text.blocks(re.sub(r"<(/?)(?:article|nav|footer|div)\b[^>]*>", r"<\1div>", page or ""))
        if len(bare) == len(found):
            right.update(("bare", y, html_text.is_main(x, node)) for x, y in zip(html_text.features(bare), truth, strict=True))
    score = lambda k: (right[k, True, True] / (right[k, True, True] + right[k, False, True]), right[k, True, True] / (right[k, True, True] + right[k, True, False]))
    print({k: score(k) for k in ("named", "bare")})
    assert min(score("named")) > 0.999 and score("bare")[0] > 0.95 and score("bare")[1] > 0.8


def test_html_goes_on_behind_elements_without_an_end():
    article = "<article><p>The article of this page stands here.</p><p>And it ends here.</p></article>"
    want = "The article of this page stands here.\nAnd it ends here."
    assert html_text.main_text(article) == want
    for head in (
        "<input list=x><datalist id=x><option value=a><option value=b></datalist>", "<datalist><option>One<option>Two</datalist>", "<div><option>One<option>Two</div>",
        "<datalist><optgroup label=x><option>One<optgroup label=y><option>Two", "<select><option>One<option>Two</select>", "<option>One", '<svg class="x" />', "<svg/>", "<math/>", "<canvas>", "<iframe src=x>", "<video src=x>" * 3,
        f'<div data-x="a > b {"y" * 5000} > c"></div>', f"<div data-x='a > b {'y' * 5000} > c'></div>", "<a title='x > y' href=/></a>", "<div title=it's></div>", "<svg><path d='x'></svg>",
    ):
        assert html_text.main_text(f"<body>{head}{article}</body>") == want, head
    inside = "<article><p>Energy is <math display='block'><mi>E</mi><mo>=</mo><mi>m</mi></math> as one knows.</p><p>It <svg width='1'/>goes on.</p></article>"
    assert html_text.main_text(inside) == "Energy is E=m as one knows.\nIt goes on."
    assert html_text.main_text("<p>" + "word " * 60 + "</p><style>p { color: red") == ("word " * 60).strip()


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>x</p></article>"), (1, None, None), (None, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [("", 0), ("", 0), ("x", 1)]


# 5


def test_levenshtein_trie():
    t = toxicity.Trie({"idiot$": 7.0, "worthless$": 6.0, "scum$": 7.0, "réeux*": 5.0, "weak$": 1.0})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return new

    r = random.Random(2)
    for _ in range(400):
        w = list(r.choice(["idiot", "worthless"]))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = r.choice(["", "x", "i"])
        w = "".join(w)
        want = max([x for term, x in (("idiot", 7.0), ("worthless", 6.0)) if distance(w, term) <= 1], default=0.0)
        assert t.near(w) == want, w
    assert t.exact("réeuxpa") == 5.0 and t.exact("idiots") == 0 and t.exact("idiot") == 7.0 and t.exact("scu") == 0


def test_toxicity(spark, docs, empty):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        words = prose(k, 40).split()
        if bad:
            words[10], words[30] = r.choice(["fiendish", "blockhead"]), r.choice(["fiendish", "wretched"])
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(bad)))
    df = spark.createDataFrame(rows, DOCS).withColumn("toxic", F.lit(9))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    got = toxicity.scores(df, model).collect()
    held = [x for x in got if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    assert sum(x["predicted"] == (x["doc_id"] % 4 == 0) for x in held) / len(held) > 0.95
    assert model.score("you are a blokhead and wretched") > 0.5 > model.score('he said "blockhead" in a quote') and 0 <= model.score("") < 0.5
    quoting = ("In his memoir he recalls that critics called the plan “{}”.", 'She reads the term "{}" aloud from the file.', "Il lit le mot «{}» dans le dossier.")
    abusive = ("You {}, get lost, {}!", "Shut up, you are a {}", "Du {}, du {}, hau ab")
    for w in ("fiendish", "blockhead", "wretched"):  # sentences that are not in the labelled table
        assert max(model.score(t.replace("{}", w)) for t in quoting) < 0.5 < min(model.score(t.replace("{}", w)) for t in abusive)
    assert toxicity.scores(docs, model).count() == len(awkward()) and toxicity.scores(empty, model).count() == 0
    assert toxicity.scores(docs, toxicity.train(docs, lab.limit(0))).agg(F.max("score")).first()[0] == 0


def test_misspelt_inflected_terms(spark):
    r = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        words = prose(5000 + k, 40).split()
        if k % 4 == 0:
            words[10] = r.choice(["dummkopf", "dummkopfs", "dummköpfe", "zzwicht", "zzwichte", "zzwichten", "blödian"])
        rows.append((k, " ".join(words), "de", "s", 0))
        labels.append((k, 1, int(k % 4 == 0)))
    model = toxicity.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "zzwichte$" not in model.lexicon and any(t[-1] == "*" and "zzwichte".startswith(t[:-1]) for t in model.lexicon)
    ends = " " + prose(9, 20)
    wrong = ["zzwlcht", "zwichte", "zzvichten", "dumnkopf", "dumkopfs", "dumm0köpfe", "blodian", "_zzwichte_", "__dummkopf"]
    asked = spark.createDataFrame([(k, w + ends, "de", "s", 0) for k, w in enumerate([*wrong, ends])], DOCS)
    got = {x["doc_id"]: x["score"] for x in toxicity.scores(asked, model).collect()}
    assert all(got[k] > 0.5 > got[len(wrong)] for k in range(len(wrong))), got


def test_every_term_of_the_lexicon_may_be_misspelt():
    t = toxicity.Trie({"wretch$": 2.6, "blockh*": 3.0}, {"blockhead": 3.0})
    assert t.near("wretsch") == 2.6 and t.near("blokhead") == 3.0 and t.near("blockhaed") == 0 and t.exact("blockhead") == 3.0 and t.near("wr") == 0


# 6


def measured(text):
    t = text or ""
    w = [x for x in SPACE.split(t) if x]
    at = defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    cov = {k + i for ks in at.values() if len(ks) > 1 for k in ks for i in range(5)}
    lines = [x for x in t.split("\n") if SPACE.sub("", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cov)


def test_quality(spark, docs, empty):
    r = random.Random(7)
    rows = awkward() + [(100 + k, " ".join(r.choice("abc|") + r.choice(["", "", "\n"]) for _ in range(r.randrange(60))), "", "", 0) for k in range(60)]
    got = quality.verdicts(spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit(0))).collect()
    have = sorted(((x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) for x in got), key=repr)
    want = sorted(((i, *(m := measured(t)), m[0] < 10 or 100 * m[4] > 20 * m[0]) for i, t, *_ in rows), key=repr)
    assert have == want
    assert all(not x["kept"] for x in got if x["base_failed"]) and quality.verdicts(empty).count() == 0
    led = quality.ledger(docs)
    ab = {x["rule"]: x for x in quality.ablations(led, "web-1").collect()}
    assert ab["few_words"]["n_failed"] == led.where("n_words < 10").count() and ab["symbols"]["n_kept_without"] >= ab["symbols"]["n_kept"]


# 7


def near_truth(rows):
    sets, text = {}, {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        text[i] = tuple(w)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    reps = {}
    for i in sorted(sets):
        reps.setdefault(text[i], i)
    ids = sorted(reps.values())
    links = {i: {j for j in ids if j != i and sets[i] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])} for i in ids}
    cls = {}
    for i in ids:
        stack = [] if i in cls else [i]
        while stack:
            k = stack.pop()
            if k not in cls:
                cls[k] = i
                stack += links[k]
    return {i: (cls[reps[text[i]]], len(links[reps[text[i]]]), reps[text[i]]) for i in sets}


def test_ngram_join(spark, docs, empty, monkeypatch):
    rows = [x for x in awkward() if x[0] is not None]
    r = random.Random(6)
    base = prose(50, 120).split()
    for k in range(40):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = "q" + str(k)
        rows.append((200 + k, " ".join(w), "", "", 0))
    df = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit(1)).withColumn("rid", F.lit(1))
    want = near_truth(rows)
    for block in (512, 7):  # the second cuts components into blocks
        monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
        got = {x["doc_id"]: (x["class_id"], x["n_links"], x["copy_id"]) for x in ngram_join.near_classes(df).collect()}
        assert got == want
    assert ngram_join.near_classes(empty).count() == 0
    assert ngram_join.near_classes(docs).count() == len(awkward())
    kept = sorted(x["doc_id"] for x in ngram_join.stage(spark, df, "").collect())
    assert kept == sorted({c for c, *_ in want.values()})


def test_near_stage_keeps_a_row_of_each_class_whatever_the_ids(spark):
    near = lambda t: " ".join([*t.split()[:-1], "zzz"])
    texts = [prose(70 + k, 80) for k in range(7)]
    rows = [(None, texts[k]) for k in range(4)] + [(None, near(texts[0])), (None, texts[1])]  # four classes without any id
    rows += [(7, texts[4]), (7, texts[5]), (7, near(texts[6])), (3, texts[6])]  # an id of two classes, and of a near copy of another id's text
    want = [*texts[1:6], texts[6]]
    for n in (1, 3):
        df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(n)
        out = ngram_join.stage(spark, df, "")
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert out.columns == df.columns and len(got) == 7
        assert sorted(t for _, t in got if t not in (texts[0], near(texts[0]))) == sorted(want)
        assert {i for i, t in got if t == texts[6]} == {3} and {i for i, t in got if t in texts[4:6]} == {7}


def test_rare_grams_take_components_apart(spark, monkeypatch):
    """Templates: much of every text is the same, and bands join them all; few of them are similar. Equal rows and rows without an id are among them."""
    r = random.Random(9)
    shared = prose(90, 60)
    rows = [(k, f"{shared} {prose(1000 + k, r.randrange(25, 90))}") for k in range(60)]
    rows += [(100 + k, t + " and more") for k, t in rows[:12]]
    rows += [(None, rows[0][1] + " x"), (None, rows[0][1] + " x"), (None, rows[1][1] + " y"), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {frozenset(x) for x in groups_by_brute_force([t for _, t in rows])}
    sizes = []
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 8)
    finer = ngram_join._finer
    monkeypatch.setattr(ngram_join, "_finer", lambda *x: sizes.append((x[0].count(), (out := finer(*x)).groupBy("comp").count().agg(F.max("count")).first()[0])) or out)
    sketches, known, _ = ngram_join._classed(df, 0.8, 1e-9)
    by_text = {x["digest"]: x["label"] for x in known.collect()}
    label = [by_text[ngram_join.digest(ngram_join.split_words(t))] for _, t in rows]
    got = {frozenset(i for i, y in enumerate(label) if y == x) for x in label}
    assert got == want
    assert sizes[0][0] > 50 and sizes[0][1] < 10  # one component of almost all texts falls into those of the similar ones


def groups_by_brute_force(texts):
    """Classes of positions: equal words, or links at 0.8 on sets of word 5-grams."""
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[i] if x == label[j] else x for x in label]
    return [[k for k, x in enumerate(label) if x == y] for y in set(label)]


@pytest.mark.parametrize("seed", range(4))
def test_rare_first_shares_a_gram_at_the_threshold(seed):
    r = np.random.default_rng(seed)
    counts = r.integers(0, 5, 1 << ngram_join.RARITY_BITS)
    for _ in range(200):
        n = int(r.integers(1, 60))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        keep = a[r.random(len(a)) < 0.93]
        b = np.unique(np.r_[keep, r.integers(0, 2**63, int(r.integers(0, 4))).astype(np.uint64)])
        shared = len(np.intersect1d(a, b))
        if len(b) and 5 * shared >= 4 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(ngram_join.rare_first(a, counts, 0.8), ngram_join.rare_first(b, counts, 0.8)))


def test_joins_of_the_near_stage_send_no_table_through_the_driver(spark, monkeypatch):
    """Spark takes a list of 32 bands for a few bytes, so it broadcast millions of them; only the bitmaps of fixed size may go."""
    plans, save = [], common.save
    monkeypatch.setattr(common, "save", lambda df, path: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(df, path))
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 8)
    shared = prose(91, 60)
    rows = [(k, f"{shared} {prose(1200 + k, 25 + k)}") for k in range(30)] + [(None, f"{prose(1300, 50)} {k % 2}") for k in range(6)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    for out in (ngram_join.stage(spark, df, ""), ngram_join.near_classes(df)):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    joins = [line for p in plans for line in p.split("\n") if re.search("BroadcastHashJoin|BroadcastNestedLoopJoin|ShuffledHashJoin|SortMergeJoin", line)]
    sent = [line for line in joins if "SortMergeJoin" not in line]
    assert len(joins) > 20 and sent and all("_part" in line for line in sent), sent


def test_rows_without_an_id_meet_their_own_text_only(spark):
    """10,000 rows without an id: a join on the id alone would make 10^8 pairs of them."""
    texts = [f"w{k} a{k % 97} b{k % 89} c{k % 83} d{k % 79} e{k} f{k} g{k}" for k in range(9000)]
    texts += [texts[k] + " h" for k in range(0, 2000, 2)]
    rows = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    out = ngram_join.stage(spark, rows, "")
    assert out.count() == len(groups_of(texts))


def groups_of(texts):
    """As groups_by_brute_force for texts whose near copies share their first word."""
    by = defaultdict(list)
    for t in texts:
        by[t.split()[0]].append(t)
    return [g for ts in by.values() for g in groups_by_brute_force(ts)]


def test_pruning_keeps_pairs_at_the_threshold():
    assert all(ngram_join.least_matches(n, 0.8, 1e-9) < 0.8 * n for n in range(16, 129, 16))
    assert [ngram_join.least_matches(n, 0.8, 1e-9) for n in (16, 64, 128)] == sorted(ngram_join.least_matches(n, 0.8, 1e-9) for n in (16, 64, 128))


# 8


def test_exact_dedup(spark, docs, empty):
    rows = awkward() + [(300 + k, prose(9, 8000) + "ab"[k % 2], "", "", 0) for k in range(4)] + [(310, " a b", "", "", 0), (311, "a b", "", "", 0), (312, "\ta\r\nb", "", "", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("idx", F.lit(1)).withColumn("sha", F.lit(1)).withColumn("n", F.lit(1))
    norm = [(i, SPACE.sub(" ", t or "")) for i, t, *_ in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    first = {t: min(g, key=lambda x: (x is not None, x or 0)) for t, g in groups.items()}
    want = sorted(((i, first[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=repr)
    for block in (8192, 16):
        got = exact_dedup.groups(df, block).collect()
        assert sorted(((x["doc_id"], x["keep_id"], x["group_size"], x["text_sha256"]) for x in got), key=repr) == want
        assert sum(x["kept"] for x in got) == len(groups)
    assert exact_dedup.groups(empty).count() == 0
    out = exact_dedup.stage(spark, df, "")
    assert out.columns == df.columns and out.count() == len(groups)


# 9


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_against_plain_patterns():
    r = random.Random(8)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4539 5787 6362 1486", "4539578763621486", "0000-0000-0000", "+1 (212) 555-0100", "+1", "+49 30 1234567 ", " ", "é", "-", ".", "12", "日本 a@b.c@d.e.f"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(9)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_addresses_with_parts_of_any_length(spark):
    """Python refuses to read numbers of more than 4,300 digits."""
    zeros = "0" * 5000
    text = f"{zeros}.1.2.3 and 1.2.3.{zeros}4 not 1.2.3.{zeros}400 nor {'9' * 5000}.1.1.1"
    assert [(k, b - a) for a, k, b in pii.base_spans(text)] == [(1, 5006), (1, 5007)]
    assert pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["n_ip"] == 2


def with_luhn(digits):
    return next(digits + c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(digits + c))) % 10 == 0)


def labelled_document(r):
    """A document of prose with entities that its templates, none of them in the labelled tables, place; and the spans beyond the base ones that belong to it."""
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 8)) + "".join(r.sample("0123", 4) + r.sample("abcd", 4))
    mixed = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(n - 8)) + "".join(r.sample("2345", 4) + r.sample("abCD", 4))
    card = with_luhn("4" + "".join(r.choice("0123456789") for _ in range(14)))
    wrong = card[:-1] + str((int(card[-1]) + r.randrange(1, 10)) % 10)
    parts, want = [], []
    say = lambda *words: parts.extend((w, False) for w in words)
    personal = lambda w: parts.append((w, True))
    for kind in r.sample(range(8), 4):
        say(*prose(r.randrange(10**6), r.randrange(5, 40)).split())
        if kind == 0:
            key = hexes(40)
            say("export token="), personal(key), say("and again, much later"), say(*prose(r.randrange(10**6), 60).split()), personal(key)
        elif kind == 1:
            say("secret:"), personal(mixed(28))
        elif kind == 2:
            say("paid by", card, "which the form misread as"), personal(wrong)
        elif kind == 3:
            say("see commit", hexes(40), "for details")
        elif kind == 4:
            say("the file", "chapter_01_section_22_final", "is gone")
        elif kind == 5:
            say("in the years", "1618 1648 1701 1714", "of war")
        elif kind == 6:
            say("password ="), personal(mixed(24)), say("for host 192.168.0.1")
        else:
            say("mail me at some.one@example.com or", "call +49 30 901820-11", "soon")
    text = ""
    for w, mine in parts:
        text += " " * bool(text and not text.endswith("="))
        if mine:
            want.append((len(text), len(text) + len(w)))
        text += w
    return text, want


def test_field_on_held_out_documents():
    r = random.Random(12)
    right = found = wanted = 0
    for _ in range(300):
        text, want = labelled_document(r)
        base = set(pii.base_spans(text))
        assert base <= set(pii.find(text)[1])
        got = {(a, b) for a, k, b in pii.find(text)[1] if (a, k, b) not in base}
        right, found, wanted = right + len(got & set(want)), found + len(got), wanted + len(want)
    precision, recall = right / found, right / wanted
    print(f"precision {precision:.3f}, recall {recall:.3f} of {wanted}")
    assert precision > 0.95 and recall > 0.95


def test_field_carries_labels_to_repeats(spark, docs, empty):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    text = f'token = "{key}" and later {key} but not 0beec7b5ea3f0fdbc95d0dd47f3c5bc275da8a33 or a.b@c.de'
    found = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(text)[1]]
    assert found == [("secret", key), ("secret", key), ("email", "a.b@c.de")]
    assert pii.find(prose(1, 200) + " in 1999 and 2001, 3.14 or 10-20")[1] == [] and pii.find(None) == ([], [])
    assert pii.redact(text).count("[SECRET]") == 2
    got = pii.personal_data(docs).collect()
    assert len(got) == len(awkward()) and pii.personal_data(empty).count() == 0
    assert all(x["base_sha256"] == hashlib.sha256(b"").hexdigest() for x in got if x["doc_id"] is None)


@pytest.mark.parametrize("n", [1, 13, 100])
def test_one_label_for_all_copies_of_a_token(n):
    key, other = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "0beec7b5ea3f0fdbc95d0dd47f3c5bc275da8a33"
    cue = f'token = "{key}"'
    bare = [f"then {key} and" for _ in range(n)]
    among = [f"then {key} at {10**11 + 37 * k} in {other}" for k in range(n)]  # neighbours without personal data
    for parts in ([cue, *bare], [*bare, cue], [*bare, cue, *bare], [cue, *among], [*among, cue]):
        text = " ".join(parts)
        found = [text[a:b] for a, k, b in pii.find(text)[1] if pii.KINDS[k] == "secret"]
        assert found == [key] * text.count(key), (n, len(found))
        assert key not in pii.redact(text) and pii.redact(text).count(other) == text.count(other)
    assert pii.find(" ".join(bare))[1] == []


def test_propagation_settles_along_a_chain():
    """As the exact marginals of a chain longer than any fixed number of rounds."""
    n, unary = 60, np.zeros((60, 2))
    unary[0, 0] = 9.0
    p = pii.propagate(unary, [(k, k + 1, 4.0, 4.0) for k in range(n - 1)])
    same = np.exp(4.0) / (np.exp(4.0) + 1)
    ahead = np.array([1 / (1 + np.exp(-9.0)), 1 / (1 + np.exp(9.0))])
    for k in range(n):
        assert p[k] == pytest.approx(ahead, abs=1e-3)
        ahead = same * ahead + (1 - same) * ahead[::-1]


# 10


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    marked = [(901, "hello <|endoftext|> x", "en", "s", 0), (902, "<|endoftext|>" * 700 + " end", "en", "s", 0)]
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x, *_ in [*awkward(), *marked] if i}
    assert ids[901].tolist() == [31373, 220, 50256, 2124, 1]
    more = spark.createDataFrame([(i, x) for i, x, *_ in marked], "doc_id long, text string")
    got = packing.pack(docs.select("doc_id", "text").unionByName(more).repartition(2), BPE, pool=4).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, want in ids.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0  # no padding at all
    assert packing.pack(empty, BPE).count() == 0


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    t, enc, r = Tokenizer.from_file(BPE), packing.added_encoder(BPE), random.Random(3)
    for _ in range(300):
        s = "".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x20, 0x3100), r.choice([32, 10, 13, 0xA0, 0x2003]), r.randrange(0x1F300, 0x1FA00)])) for _ in range(25)) + r.choice(["", "<|endoftext|>", "\n\n  "])
        assert t.encode(s, add_special_tokens=False).ids == enc(s)


def test_added_tokens_are_found_in_texts(spark):
    from tokenizers import Tokenizer

    t, enc, r = Tokenizer.from_file(BPE), packing.added_encoder(BPE), random.Random(4)
    assert enc("a <|endoftext|> b") == [64, 220, 50256, 275]
    bits = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", " word", "'s", "12", "é", "日本", "<|", "<|EndOfText|>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(500)]
    assert all(enc(x) == t.encode(x, add_special_tokens=False).ids for x in texts)
    got = {x["doc_id"]: x for x in packing.pack(spark.createDataFrame([(k, x, "", "", 0) for k, x in enumerate(texts[:20])], DOCS).coalesce(1), BPE).where("start = 0").collect()}
    for k, x in enumerate(texts[:20]):
        want = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        assert got[k]["doc_tokens"] == len(want) and got[k]["ids_crc32"] == zlib.crc32(want[: got[k]["length"]].tobytes())


def first_fit(pieces, rooms):
    """As they come, each piece to the first sequence with room, cut where there is none."""
    room, seqs = list(rooms), [[] for _ in rooms]
    for doc, start, size in pieces:
        while size and any(room):
            k = next((k for k, free in enumerate(room) if free >= size), None)
            k = next(k for k, free in enumerate(room) if free) if k is None else k
            part = min(size, room[k])
            seqs[k].append((doc, start, part))
            room[k], start, size = room[k] - part, start + part, size - part
    return seqs


@pytest.mark.parametrize("rooms", [[2048] * 40, [2048] * 64, [1024, 512, 256, 64, 8, 1]])
def test_fill_balances_cost(rooms):
    """Every sequence is full, no token is lost or cut twice; among sequences of one length, costs differ less than under first fit."""
    wider = 0
    for seed in range(20):
        r = random.Random(seed)
        pieces, k = [], 0
        while sum(p[2] for p in pieces) < sum(rooms):
            pieces.append((k, 0, min(2047, int(r.lognormvariate(5.5, 1.2)) + 1)))
            k += 1
        seqs, left = packing.fill(pieces, rooms)
        assert [sum(p[2] for p in s) for s in seqs] == rooms
        ids = sorted((d, at + j) for s in [*seqs, left] for d, at, n in s for j in range(n))
        assert ids == [(d, j) for d, _, n in pieces for j in range(n)]
        work = lambda found: np.std([sum(packing.cost(p[2]) for p in s) / room for s, room in zip(found, rooms, strict=True)])
        wider += work(first_fit(pieces, rooms)) > work(seqs)
    assert wider >= 16 or len(set(rooms)) > 1


# Pipeline


@pytest.mark.parametrize("stage", [exact_dedup.stage, ngram_join.stage, pii.stage, quality.stage])
def test_stages_leave_other_columns_alone(spark, stage):
    """Whatever the columns are called: none of them is read, written over or lost."""
    names = ["id", "sha", "digest", "doc", "row", "nth", "rid", "_sha", "_id", "_row", "_m", "n_words", "kept", "failed_rules", "first", "comp", "batch", "a.b", "text_sha256"]
    rows = [(k, prose(k, 40), *[f"{n}-{k}" for n in names]) for k in range(4)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted({tuple(r) for r in out.collect()}) == sorted(rows)
    assert stage(spark, df.limit(0), "").count() == 0


def test_pipeline(spark, tmp_path):
    """Exactly the rows that the plain rules leave: with ids that are null, repeated and equal, and texts that are."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, *x) for i, t, *x in awkward() if "x" * 50 not in (t or "")]
    more = [prose(400 + k, 70) for k in range(6)]
    rows += [(None, more[0], "en", "s", 0), (None, more[1], "en", "s", 0), (None, more[1], "en", "s", 0), (7, more[2], "en", "s", 0), (7, more[3], "en", "s", 0)]
    rows += [(7, more[2] + " end", "en", "s", 0), (70, more[4], "en", "s", 0), (71, more[4].replace(" ", "\n"), "en", "s", 0), (None, more[5] + " end", "en", "s", 0), (72, more[5], "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    good = [(i, t) for i, t, *_ in rows if not (lambda m: m[0] < 10 or 100 * m[4] > 20 * m[0])(measured(t)) and quality_keeps(t)]
    kept = []
    for group in groups_by_brute_force([t for _, t in good]):
        kept.append(min((good[k] for k in group), key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256(x[1].encode()).digest())))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    tokens = lambda x: len(t.encode(pii.redact(x), add_special_tokens=False).ids) + 1
    want = sorted((i if i is not None else -1, tokens(x)) for i, x in kept)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["doc_tokens"]) for r in got if r["start"] == 0) == want
    assert sum(r["length"] for r in got) == sum(n for _, n in want)


def quality_keeps(text):
    """The method's rules beyond the base ones, as the operator states them."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols, chars = sum(c in "#*$%&|<>" for c in text), sum(map(len, words))
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    bad = text.count(chr(0xFFFD))
    return not (10 * symbols > len(words) or 2 * (len(lines) - len(set(lines))) > len(lines) or 10 * stutter > 3 * len(words) or chars < 2 * len(words) or chars > 20 * len(words) or 100 * bad > chars)


@pytest.mark.parametrize("size", [5, 23])
def test_unigram_chunks_weigh_what_the_whole_text_does(size):
    v = sp.vocabulary(PIECES, sp.UNIGRAM)
    for text in ("internationalisation of things, indeed. " * 4, prose(5, 30)):
        t = v.model.normalize(text)
        cuts, reach = [*range(0, len(t), size), len(t)], v.longest + 1
        parts = [(k, min(lo, reach), hi - lo, t[max(0, lo - reach) : hi + reach]) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
        ends = [sp._ends(v, b, left, n, k, len(parts)) for k, left, n, b in parts]
        ends[-1] = (ends[-1][0], [s for s in ends[-1][1] if s[0] + s[1] == 0])
        ms = [v.matrix(b, left, left + n, *e) for (k, left, n, b), e in zip(parts, ends, strict=True)]
        inner, last = sp.cut_states(ms), int(sp.scan(ms)[-1].max(0).argmax())
        out = []
        for (k, left, n, b), (en, ex), i, o in zip(parts, ends, [0, *inner], [*inner, last], strict=True):
            begin, end = left + en[i][0] + en[i][1], left + n + ex[o][0]
            if end >= begin:
                out += sp.traced(v, b, begin, end, en[i], left)
                if ex[o][0] >= -n:
                    out += v.spelled(b[end : end + ex[o][1]], [(ex[o][1], ex[o][2])])
        steps, weight = v.best(t)
        assert v.decode(np.array(out, np.int32)) == t
        assert sum(v.score[i] for i in out) == pytest.approx(weight) == pytest.approx(sum(v.score[i] for _, i in steps))
