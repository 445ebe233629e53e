"""Main text of web pages by two passes over their blocks.

The first pass gives each block a label: blocks in page furniture (menus, headers, footers, sidebars,
notices, adverts, forms, comments: by element, role, class or id) are bad; the others are judged by
link density, length and the share of stop words, and short ones stay undecided. In an article that the page marks, names count as furniture only where they are plain, and running
text may hold any number of links. The second pass gives
every undecided block the label of its nearest decided neighbour (in the article, if the page marks
one); a tie is good only if both sides are.

Edge cases: null or empty html gives an empty text; markup that never ends is read to the end of the
page; pages without any tag are one block; repeated rows are handled row by row; an empty table gives an
empty result. Nothing is capped. `text` joins the good blocks in page order by one line feed.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, free_name, load, whole

SHORT, LONG = 70, 200
LINKS = 0.5
STOP_LOW, STOP_HIGH = 0.08, 0.16
# Function words of the languages of the corpus.
STOP_WORDS = frozenset(
    "the and of to in a is that for it as with was on are by this be from at or an he his not but have had they you we which one all were there been if more when will would who so no"
    " le la les de des du et en un une que qui dans pour par sur est au aux avec ce il elle ne pas se plus son sa ses ou mais nous vous ils elles"
    " der die das und ist von zu mit den im ein eine nicht auf dem des sich als auch es an er sie wir ihr oder aber wie bei nach aus"
    " el los las y del al lo por con para una su sus como más pero sin o este esta".split()
)
SKIPPED = frozenset("script style noscript template svg math iframe object select textarea button canvas audio video title".split())
FURNITURE = frozenset("nav footer aside form dialog menu fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text, and those of them that aren't paragraphs or headings.
TEXT = HEADINGS | {"p", "span"}
TOLD = frozenset("blockquote dd figcaption pre td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that furniture hints count for, and that are matched with their end tags.
NESTED = frozenset("article aside body details dialog div dl fieldset figure footer form header li main menu nav ol p section span table tbody td tr ul".split())
#: Words of a class or id that mark furniture wherever they stand in it, in names of up to three words ...
SURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar navbar breadcrumb breadcrumbs cookie cookies consent gdpr newsletter subscribe subscription signup popup modal overlay share sharing social comment comments commentlist disqus login pagination pager".split()
)
#: ... and those that do only outside the article, or as a whole name: an article has headers, notices and sections of its own.
HINTS = SURE | frozenset("banner nav navigation menu header masthead footer notice alert related recommended recommendations reply replies respond reader widget search legal copyright skip toolbar teaser".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>""")
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("article", "bad", "heading", "linked", "parts", "told")

    def __init__(self, bad: bool, article: bool, told: bool) -> None:
        self.parts: list[str] = []
        self.linked, self.bad, self.article, self.told, self.heading = 0, bad, article, told, False


def _marked(name: str, names: str, in_article: bool) -> bool:
    """Whether a class or an id names furniture."""
    words = [_PARTS.findall(_CAMEL.sub(" ", x).lower()) for x in names.split()]
    if not in_article:
        return any(not HINTS.isdisjoint(w) for w in words)
    # In the article a paragraph or heading is text unless its whole name says otherwise.
    if any(len(w) == 1 and w[0] in (SURE if name in TEXT else HINTS) for w in words):
        return True
    return name not in TEXT and any(len(w) <= 3 and not SURE.isdisjoint(w) for w in words)


def _furniture(name: str, attrs: str, in_article: bool) -> bool:
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            if name not in ("body", "html", "main", "article") and _marked(name, value, in_article):
                return True
        elif key == "role" and value.lower() in ROLES or key == "style" and _HIDDEN.search(value.lower()) or key == "aria-hidden" and value.lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attrs))


class Open:
    """The open elements, innermost last; every step is done in the time of what it opens or closes."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # element, whether it is furniture, whether it is the article
        self.count: dict[str, int] = {}
        self.inline = [{"p": 0, "span": 0}]  # those open since the last other element
        self.bad = self.article = 0

    def push(self, name: str, furniture: bool, article: bool) -> None:
        self.stack.append((name, furniture, article))
        self.count[name] = self.count.get(name, 0) + 1
        self.bad += furniture
        self.article += article
        if name in self.inline[-1]:
            self.inline[-1][name] += 1
        else:
            self.inline.append({"p": 0, "span": 0})

    def pop(self) -> str:
        name, furniture, article = self.stack.pop()
        self.count[name] -= 1
        self.bad -= furniture
        self.article -= article
        if name in self.inline[-1]:
            self.inline[-1][name] -= 1
        else:
            self.inline.pop()
        return name

    def close(self, name: str) -> None:
        """Closes the innermost element of that name and all in it; a paragraph or span ends only what no other element parts from it."""
        if self.inline[-1][name] if name in self.inline[-1] else self.count.get(name):
            while self.pop() != name:
                pass

    def end_paragraph(self) -> None:
        while self.stack and self.stack[-1][0] in self.inline[-1]:
            self.pop()


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with what is needed to label them."""
    out: list[Block] = []
    opened, link, told = Open(), 0, 0
    now: Block | None = None
    breaks = 0

    def add(raw: str) -> None:
        nonlocal now, breaks
        if not raw or raw.isspace() and now is None:
            return
        if now is None:
            now = Block(opened.bad > 0, opened.article > 0, opened.inline[-1]["p"] > 0 or told > 0)
            out.append(now)
        text = _html.unescape(raw)
        now.parts.append(text)
        if link:
            now.linked += len(" ".join(text.split()))
        if not raw.isspace():
            breaks = 0

    pos, n, low = 0, len(page), None
    no_close = False
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            add(page[pos:])
            break
        if lt > pos:
            add(page[pos:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            pos = n if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            pos = n if end < 0 else end + 1
            continue
        if not (nxt.isascii() and nxt.isalpha() or nxt == "/") or no_close:
            add("&lt;")
            pos = lt + 1
            continue
        m = _TAG.match(page, lt)
        if m:
            closing, name, attrs, pos = m[1] == "/", m[2].lower(), m[3], m.end()
        else:  # an odd quote: the tag ends at the next bracket
            end = page.find(">", lt)
            if end < 0:
                no_close = True
                continue
            body = page[lt + 1 : end].lstrip("/")
            closing, name, attrs, pos = nxt == "/", (body.split() or [""])[0].lower(), "", end + 1
        if name in SKIPPED and not closing and not attrs.endswith("/"):
            if low is None:
                low = page.lower() if len(page.lower()) == n else page
            end = low.find(f"</{name}", pos)
            if end < 0:
                pos = n
            else:
                end = page.find(">", end)
                pos = n if end < 0 else end + 1
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                now = None
            else:
                add(" ")
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name in BLOCKS:
            now, breaks = None, 0
            if name in ("p", "div", "li", "td", "article", "section"):
                link = 0
        if name in TOLD:
            told = 0 if closing else 1
        if name in NESTED:
            if closing:
                opened.close(name)
            elif not attrs.endswith("/"):
                if name == "p":  # a paragraph ends the one before it
                    opened.end_paragraph()
                f, a = _furniture(name, attrs, opened.article > 0), name in ("article", "main")
                if f or name != "span" or a:
                    opened.push(name, f, a)
                    if f and name == "span":
                        now = None
        if name in HEADINGS and not closing:
            now = Block(opened.bad > 0 or _furniture(name, attrs, opened.article > 0), opened.article > 0, True)
            now.heading = True
            out.append(now)
    return out


def labels(found: list[Block], texts: list[str]) -> list[bool]:
    marked = any(b.article and not b.bad and t for b, t in zip(found, texts))
    first: list[bool | None] = []
    for b, t in zip(found, texts):
        if b.bad or not t or marked and not b.article:
            first.append(False)
            continue
        links = b.linked / len(t)
        words = t.lower().split()
        stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
        if links >= LINKS and (len(t) < LONG or stops < STOP_HIGH) and not (marked and b.told):
            first.append(False)  # a menu; a paragraph of the article may well be one link
        elif len(t) < SHORT:
            first.append(False if links > 0.2 and not marked else None)
        elif stops >= STOP_HIGH or stops >= STOP_LOW and len(t) >= LONG or marked:
            first.append(True)
        else:
            first.append(None if stops >= STOP_LOW else False)
    own = [i for i, (b, t) in enumerate(zip(found, texts)) if t and (b.article or not marked)]
    out = [x is True for x in first]
    decided = [(p, first[i]) for p, i in enumerate(own) if first[i] is not None]
    at = 0
    for p, i in enumerate(own):
        if first[i] is not None:
            continue
        while at < len(decided) and decided[at][0] < p:
            at += 1
        left, right = decided[at - 1] if at else None, decided[at] if at < len(decided) else None
        if marked and not any(d[1] for d in (left, right) if d) and not (left and right):
            out[i] = left is None or right is None or bool(found[i].heading)
        elif left and right:
            a, b = p - left[0], right[0] - p
            out[i] = left[1] if a < b else right[1] if b < a else left[1] and right[1] or marked
        else:
            side = left or right
            out[i] = bool(side[1]) if side else True
    return out


def extract(page: str | None) -> str:
    """The main text of a page."""
    found = blocks(page or "")
    texts = [" ".join("".join(b.parts).split()) for b in found]
    return "\n".join(t for t, good in zip(texts, labels(found, texts)) if good and t)


def main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """The other columns of `pages`, with `out` in the place of the html."""
    others = [c for c in pages.columns if c != html]
    if out in others:
        raise ValueError(f"the input already has a column {out}")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([extract(x) for x in b.column(len(others)).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*others, out])

    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in others)
    return arrow_map(pages.select(*others, whole(html).alias(free_name(pages, "__html"))), run, f"{schema}`{out}` string")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its main text and the number of its characters."""
    found = main_text(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
