"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks. Each has its word count, its link density (words
inside links), the same two of the blocks before and after it, and what its enclosing elements say of it: whether
one is an article, whether one is an element for boilerplate (menus, footers, forms and the like), and whether one is named
as such. A decision tree, grown here on small labelled pages, says which are main text. Most labelled pages are there a second time with
no telling element or name left, so that the tree must tell blocks by their counts and their neighbours' where it has nothing else. Counts
alone cannot give the right text: an advert, a notice or a reader's comment is prose like the article's, and a short paragraph is as short as a footer.

Pages are worked on one by one in one pass, without a shuffle. The scanner is linear in
the page and needs no well-formed markup.

Nulls and edge cases: a null html is an empty page with an empty text; a page cut off inside a tag,
a comment or a script ends there; ids and urls may be null or repeated; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|!--|[!?][^>]*(?:>|\Z))")
RAW = frozenset("script style title textarea noscript template iframe svg object head select canvas audio video".split()) - {"head"}
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
OPTIONS = frozenset(("datalist", "optgroup", "option"))  # lists of choices, whose end tags may be left out
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
BOILER = frozenset("nav aside footer header form menu button dialog fieldset label head".split()) | OPTIONS
#: Words of class, id and role that name boilerplate, after splitting at anything but letters.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments reply replies respond disqus cookie cookies consent notice alert popup modal overlay "
    "menu nav navbar navigation sidebar sidenav footer header masthead toolbar topbar login signup subscribe newsletter share sharing social promo promoted promotion sponsor sponsored "
    "related recommended recommendations widget widgets search pagination pager copyright legal disclaimer banner contentinfo complementary skip paywall".split()
)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: In a tag: a value's opening quote, a value without quotes, or the end.
VALUE = re.compile(r"""=\s*(?:(["'])|[^\s>"'][^\s>]*)|>""")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ABSENT = re.compile(r"(?i)(?:no|has|with|without|hide|show|toggle)[-_]")  # names that speak of something elsewhere
#: Elements that hold text rather than sections; their names count only as a whole.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption summary a b i em strong span small u code".split())


@lru_cache(maxsize=4096)
def _named(attributes: str, textual: bool) -> str:
    """What attributes say: 'hidden', 'boiler' or ''. A part of a section's name is enough; of a textual element it must be a whole name."""
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return "hidden"
        if key in ("class", "id", "role", "itemprop"):
            names = [n for n in value.split() if not ABSENT.match(n)]
            words = {n.lower() for n in names} if textual else {w.lower() for n in names for w in re.split(r"[^A-Za-z]+", CAMEL.sub(" ", n))}
            if words & BOILER_WORDS:
                return "boiler"
    return ""


def _tag_end(page: str, at: int) -> int:
    """Where the > stands that ends a tag, whose attributes begin at ``at``; one inside a quoted value does not, if the quote is ever closed."""
    while m := VALUE.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if m[1]:
            close = page.find(m[1], at)
            if close < 0:
                end = page.find(">", at)
                return len(page) if end < 0 else end
            at = close + 1
    return len(page)


#: What enclosing elements say, as bits: an article, an element for boilerplate, a name of boilerplate.
ARTICLE, ELEMENT, NAME = 1, 2, 4


class Block:
    __slots__ = ("text", "words", "linked", "around")

    def __init__(self, text: str, words: int, linked: int, around: int):
        self.text, self.words, self.linked, self.around = text, words, linked, around


def blocks(page: str) -> list[Block]:
    """Flat text blocks in page order, without those that are hidden."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()  # names on the stack
    kept: list[str] = []
    linked: list[str] = []
    link = 0
    endless: set[str] = set()  # elements of RAW without an end tag in the rest of the page

    def flush() -> None:
        text = " ".join(entities.unescape("".join(kept)).split())
        around = stack[-1][1] if stack else 0
        if text and around >= 0:
            n = text.count(" ") + 1
            out.append(Block(text, n, min(n, len(entities.unescape("".join(linked)).split())), around))
        kept.clear()
        linked.clear()

    def said(text: str) -> None:
        kept.append(text)
        if link:
            linked.append(text)

    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            said(page[at:])
            break
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        if page.startswith("<!--", m.start()):
            end = page.find("-->", m.start() + 2)
            at = len(page) if end < 0 else max(end + 3, m.start() + 4)
            continue
        if m[2] is None:
            continue
        name, rest = m[2].lower(), m[3]
        if '"' in rest or "'" in rest:  # there may be a > inside a quoted value
            end = _tag_end(page, m.start(3))
            rest, at = page[m.start(3) : end], min(end + 1, len(page))
        if m[1]:
            if name in BLOCKS or name in OPTIONS:
                flush()
            elif name == "a":
                link = max(0, link - 1)
                if linked:
                    linked.append(" ")
            while open_[name]:
                last = stack.pop()[0]
                open_[last] -= 1
                if last == name:
                    break
            continue
        if name in RAW:
            if name in BLOCKS:
                flush()
            if name == "svg" and rest.endswith("/") or name in endless:
                continue
            end = re.compile(rf"(?i)</{re.escape(name)}\b[^>]*(?:>|\Z)").search(page, at)
            if end is not None:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            else:
                endless.add(name)
            continue
        if name == "br":
            said(" ")
            continue
        if name in BLOCKS or name in OPTIONS:
            flush()
            while stack and (stack[-1][0] == "option" or stack[-1][0] in OPTIONS and name in BLOCKS or stack[-1][0] == name == "optgroup"):
                open_[stack.pop()[0]] -= 1
            if name in BLOCKS and stack and stack[-1][0] == "p":
                open_[stack.pop()[0]] -= 1
        if name == "a":
            link = 1
        if name in VOID or rest.endswith("/") and name not in BLOCKS and name != "a":
            continue
        if name in BLOCKS or name in BOILER or " " in rest or name in MAIN:
            around = stack[-1][1] if stack else 0
            named = _named(rest, name in TEXTUAL) if "=" in rest or "hidden" in rest else ""
            if named == "hidden" and name not in ("body", "html"):
                flush()
                around = -1
            if around >= 0:
                if name in BOILER and not (name == "header" and around == ARTICLE):
                    flush()
                    around = around & ~ARTICLE | ELEMENT
                if named and name not in MAIN and name not in ("body", "html"):
                    flush()
                    around = around & ~ARTICLE | NAME
                if name in MAIN and not around:
                    around = ARTICLE
            stack.append((name, around))
            open_[name] += 1
    flush()
    return out


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """Of each block: words and link density of it, of the one before and of the one after; what the elements around it say."""
    own = [(float(b.words), b.linked / b.words) for b in found]
    edge = (0.0, 0.0)
    bits = lambda x: (float(x & ARTICLE > 0), float(x & ELEMENT > 0), float(x & NAME > 0))
    return [(*own[k], *(own[k - 1] if k else edge), *(own[k + 1] if k + 1 < len(own) else edge), *bits(b.around)) for k, b in enumerate(found)]


#: Labelled pages. Numbers stand for so many words, +n-m of the main text, -n-m of anything else, and an a before them for words of a link.
LABELLED = (
    "<nav><ul><li>{a1-2}<li>{a1-2}<li>{a1-3}<li>{a1-2}</ul></nav><div class=ad>{-3-16}</div><article><h1>{+4-14}</h1><p>{+20-120}<p>{+4-12}<p>{+30-160} {a1-4} {+5-20}<p>{+40-90}</article><footer>{-5-18}</footer>",
    "<header><div>{a1-3}</div><div>{-3-9}</div></header><div class=cookie-notice><p>{-15-40}</p></div><main><h1>{+5-12}</h1><p>{+3-7}<p>{+50-140}<ul><li>{+4-20}<li>{+4-20}</ul><p>{+25-80}</main><aside><h3>{-2-3}</h3><p>{-15-60}</aside>"
    "<section id=comments><h2>{-2-4}</h2><div class=comment><p>{-8-70}</div><div class=comment><p>{-8-90}</div></section><footer><p>{-4-9} {a1-2} {a1-2}</footer>",
    "<div id=top><a href=/>{a1-3}</a></div><div id=menu><ul><li>{a1-2}<li>{a1-2}<li>{a1-2}</ul></div><div id=page><h2>{+4-11}</h2><div>{-2-5} {a1-2}</div><p>{+35-120}<p>{+45-150}<p>{+20-60} {a2-5} {+9-30}</div>"
    "<div class=related-posts><h4>{-1-3}</h4><ul><li>{a4-9}<li>{a4-9}<li>{a4-9}</ul></div><div class=sidebar><p>{-10-40}</div><div id=footer>{-4-12}</div>",
    "<table><tr><td>{a1-2}<td>{a1-2}<td>{a1-2}</table><table><tr><td><h1>{+4-9}</h1><p>{+60-180}<p>{+30-90}<p>{+5-14}<p>{+40-110}</table><p>{a1-2} {a1-2} {a1-2}<p>{-3-8}",
    "<form action=/s><label>{-1-3}</label><input></form><article><header><h1>{+4-12}</h1></header><p>{+20-70}<blockquote>{+10-40}</blockquote><h2>{+2-6}</h2><p>{+30-100}<pre>{+5-30}</pre><p>{+6-13}"
    "<div class=newsletter-signup><p>{-10-30}</p></div><p>{+25-90}</article><div class=share><a href=x>{a1-2}</a> <a href=y>{a1-2}</a></div><div class=respond><p>{-3-12}</p></div>",
    "<p>{+40-160}<p>{+8-30}<p>{+50-140}", "<h1>{+3-9}</h1><p>{+20-60}<p>{+20-60}<p>{+2-5}<p>{+30-90}", "<div><a href=/>{a1-2}</a></div><h1>{+3-8}</h1><p>{+30-120}<p>{+2-5}<p>{+50-120}<p>{+15-40} {a2-4} {+15-40}<div>{-3-6}</div>",
    "<ul><li>{a1-2}<li>{a1-2}<li>{a1-3}<li>{a2-4}</ul><div>{-4-9} {a1-3}</div><h1>{+5-10}</h1><p>{+45-120}<p>{+30-90}<p>{+60-140}<div>{a3-6}</div><div>{a4-8}</div><div>{a4-8}</div><p>{-4-9}",
    "<ul><li>{a1-2}<li>{a1-2}</ul><p>{a8-20} {-1-3}<p>{a9-20} {-1-3}<p>{a8-18} {-1-3}<p>{a1-2}<p>{-3-5}",
    "<nav>{a1-2} {a1-2}</nav><article><h1>{+3-8}</h1><ol><li>{a3-9}<li>{a2-9} {+1-4}<li>{a3-8}</ol><p>{+5-12}</article><div class=pagination>{a1-2} {a1-2}</div><footer>{a1-2} {-2-6}</footer>",
)
#: Pages that only names can tell apart: blocks of any length on either side.
LABELLED_BY_NAME = (
    "<div class=menu><p>{-1-4}<p>{-1-100}</div><article><p>{+1-160}<p>{+1-3}<p>{+1-160}<p>{+1-6}<p>{+1-160}<h2>{+1-8}</h2><p>{+1-90}<p>{+1-160}<p>{a1-3}<p>{+1-160}</article><div class=comments><p>{-1-6}<p>{-1-160}</div><footer><p>{-1-160}</footer>",
    "<p>{-2-7}<main><p>{+1-3}<p>{+1-160}<p>{+1-12}<aside><p>{-1-160}</aside><p>{+1-3}<p>{+1-160}<p>{a1-9}<p>{+1-3}<p>{+1-160}</main><p>{-2-7}",
    "<aside>{-1-160}<p>{a1-20}<p>{-1-160} {a1-9}</aside><div class=menu><p>{-1-160} {a1-20}<p>{a1-60}<p>{-1-6}</div><footer>{-1-9} {a1-20}<p>{-1-160}<p>{-1-160}</footer>",
    "<div class=comments><p>{-1-160}<p>{-1-160} {a1-5}<p>{a1-30}<p>{-1-160}</div><article><p>{a1-60}<p>{+1-160}<p>{+1-30} {a1-60}<div class=share><p>{-1-160}<p>{a1-30}</div><p>{+1-160}</article>",
    "<nav><p>{-1-5}<p>{-1-30} {a1-20}<p>{a1-9}<p>{-1-6} {a1-6}<p>{a2-9}</nav><main><p>{+5-60}</main><div class=related><p>{-1-5}<p>{-1-30} {a1-20}<p>{a1-9}<p>{-1-6} {a1-6}<p>{a2-9}</div>",
    "<article><p>{+1-30}<p>{+1-30}</article>", "<main>{+1-40}</main>", "<article><h1>{+1-9}</h1><p>{+1-160}<p>{+1-9}</article><div class=ad>{-1-160}</div>", "<div class=banner>{-1-160}</div><p>{+30-90}", "<article><p>{+1-60} {a1-9}<p>{a1-20}</article>",
    "<nav>{a1-2}</nav><aside>{-20-90}</aside><div class=comments><p>{-30-120}<p>{-5-60}</div><footer>{-10-60}</footer>",
)
SAMPLES = 30
MARK = "\u2021"  # begins words of the main text in the labelled pages
SLOT = re.compile(r"\{([+a-])(\d+)-(\d+)\}")


def labelled_page(template: str, seed: int, bare: bool) -> str:
    """A page of a template, its numbers drawn; a ``bare`` one has no telling element or name left, as nothing but blocks and links is."""
    r = random.Random(seed)

    def drawn(m: re.Match) -> str:
        words = " ".join("w" * r.randrange(2, 9) for _ in range(r.randrange(int(m[2]), int(m[3]) + 1)))
        return f"<a href=/>{words}</a>" if m[1] == "a" else MARK + words if m[1] == "+" else words

    if bare:
        template = re.sub(r"<(/?)(?:%s)\b[^>]*>" % "|".join(sorted(BOILER | MAIN | {"section", "div"}, key=len, reverse=True)), r"<\1div>", template)
    return SLOT.sub(drawn, template)


def labelled_blocks() -> list[tuple[tuple[float, ...], int]]:
    """The blocks of the labelled pages, in both forms; a list of links in an article is part of it."""
    rows = []
    for k, template in enumerate(LABELLED + LABELLED_BY_NAME):
        for n in range(SAMPLES):
            for bare in (False, True)[: 1 + (template in LABELLED)]:
                found = blocks(labelled_page(template, 1000 * k + n, bare))
                rows += [(x, int(MARK in b.text or b.around == ARTICLE)) for x, b in zip(features(found), found, strict=True)]
    return rows


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 7, least: int = 1):
    """A tree by Gini impurity: a leaf is 0 or 1, a node is (feature, threshold, at most, above)."""
    ones = sum(y for _, y in rows)
    if not depth or ones in (0, len(rows)) or len(rows) < 2 * least:
        return int(2 * ones >= len(rows))
    impurity = lambda a, n: 2 * a * (n - a) / n if n else 0.0
    best = None
    for f in range(len(rows[0][0])):
        ordered = sorted(rows, key=lambda r: r[0][f])
        left = 0
        for k in range(1, len(ordered)):
            left += ordered[k - 1][1]
            if ordered[k - 1][0][f] < ordered[k][0][f] and least <= k <= len(rows) - least:
                score = impurity(left, k) + impurity(ones - left, len(rows) - k)
                if best is None or score < best[0] - 1e-12:
                    best = (score, f, (ordered[k - 1][0][f] + ordered[k][0][f]) / 2)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut = best
    return (f, cut, grow([r for r in rows if r[0][f] <= cut], depth - 1, least), grow([r for r in rows if r[0][f] > cut], depth - 1, least))


@cache
def tree():
    return grow(labelled_blocks(), 12, 3)


def is_main(x: tuple[float, ...], node) -> bool:
    while not isinstance(node, int):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return bool(node)


def main_text(page: str | None, node=None) -> str:
    node = tree() if node is None else node
    found = blocks(page or "")
    return "\n".join(b.text for b, x in zip(found, features(found), strict=True) if is_main(x, node))


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (main text, empty if none) and n_chars."""
    node = tree()  # grown once, here

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py(), node) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
