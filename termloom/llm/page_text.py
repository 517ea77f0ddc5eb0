"""HTML extraction by maximum-scoring subsequence.

A page is read as a row of words and tags. Words score positive and tags negative, with
weights learned from pages that label their own content with an article or main element. One
linear scan finds the contiguous region with the highest sum; its words, in blocks, are the
text. Elements that say they are something else by tag or role, or whose class or id is the whole
name of a menu, an advert, comments and the like, are a single negative token each and give no
words. Other marked names are negative tokens too, but what is inside is scored: a box is read if
it holds more than the rest of the page, or if it stands inside the region and has a positive sum.

Null html is empty. A page without a region of positive score has the empty text. Repeated
rows are read each; other columns are ignored; without labelled pages the prior weights stay. An
empty table gives an empty one. A page is read in time that grows with its length, whatever is left
open or nested in it; a very long one needs some times its own size of memory.
"""

from __future__ import annotations

import html
import math
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import by_bytes, map_arrow, table

GROUP_BYTES = 4 << 20

_TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    regex.DOTALL,
)
_ATTRIBUTE = regex.compile(
    r"(?P<name>[a-zA-Z-]+)\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s\"'>]+))"
)
_PART = regex.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")

RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "head"}
# Searched in the source as it is: lower case may have more characters.
_ENDS = regex.ASCII | regex.IGNORECASE
_RAW_END = {name: regex.compile(rf"</{name}(?=[\s/>]|\Z)", _ENDS) for name in RAW}
_BODY = regex.compile("<body", _ENDS)
_TAG_START = regex.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_CONTENT_START = regex.compile(r"<(?:article|main)(?=[\s/>])", _ENDS)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
# Inside a block; every other tag ends one.
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
SPACE = {"br", "hr"}
CONTENT = {"article", "main"}
OTHER = {
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea",
    "fieldset", "option", "datalist",
}
# Opening one of these ends a paragraph left open; an item ends the item before it.
ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav",
    "ol", "p", "pre", "section", "table", "ul",
}
ENDS_SAME = {"li", "dt", "dd", "tr", "td", "th", "option"}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "advertising", "sponsor",
    "sponsored", "promo", "promotion", "banner", "sidebar", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "masthead", "header", "footer", "cookie",
    "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing",
    "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist",
    "disqus", "respond", "replies", "widget", "toolbar", "pagination", "pager", "paywall",
    "copyright", "disclaimer", "complementary", "contentinfo", "search", "hidden",
}
NOT_MARKS = {"has", "with", "no", "without"}
# Whole names made of these are no content wherever they stand, but may be about it in an id.
STRONG = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored",
    "breadcrumb", "breadcrumbs", "navbar", "nav", "menu", "masthead", "footer", "cookie", "cookies",
    "consent", "gdpr", "popup", "modal", "newsletter", "signup", "login", "comment", "comments",
    "commentlist", "disqus", "respond", "replies", "pagination", "pager", "paywall", "complementary",
    "contentinfo", "hidden",
}
# Boxes of these names may be part of an article, as may whatever has its name by id.
MAYBE = {
    "header", "notice", "notices", "alert", "related", "search", "social", "promotion",
    "disclaimer", "copyright", "recommended", "recommendations", "subscription", "notification",
}
BOX = {
    "area", "bar", "block", "blog", "bottom", "box", "col", "column", "container", "global", "group",
    "inner", "item", "items", "links", "list", "main", "outer", "page", "panel", "section",
    "site", "slot", "top", "unit", "wrap", "wrapper",
}
OF_CONTENT = {"entry", "post", "article", "story", "content", "title", "text", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TAGS = sorted(
    INLINE | ENDS_P | ENDS_SAME | CONTENT | OTHER | VOID
    | {"body", "html", "tbody", "thead", "tfoot", "figcaption", "summary", "caption", "center"}
)

# Before any page is seen, and the range that a learned weight may take.
WORD, LINKED = "word", "linked word"
PRIOR = {WORD: 1.0, LINKED: -0.5}
PRIOR_INLINE, PRIOR_TAG, PRIOR_OTHER = -0.1, -0.3, -3.0
WORD_RANGE, LINKED_RANGE, TAG_RANGE, OTHER_RANGE = (0.5, 1.0), (-1.0, 0.5), (-1.5, -0.1), (-3.0, -1.0)


def mark(name: str, rest: str) -> tuple[str, str] | None:
    """How much the element says that it is not content, and by which name.

    ``other``: it is left out. ``maybe`` and ``box``: it is left out if its sum says so; a ``box``
    is read only if it holds more than the rest of the page. ``soft``: a negative token.
    """
    if name in OTHER:
        return "other", name
    if name in CONTENT or name in ("html", "body") or "=" not in rest:
        return None
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        key = m["name"].lower()
        if key == "hidden" or key == "aria-hidden" and "true" in m[0]:
            return "other", "marked"
        if key not in ("class", "id", "role") or key == "id" and name in HEADINGS:
            continue
        for word in (m["a"] or m["b"] or m["c"] or "").split():
            parts = {p.lower() for p in _PART.findall(word)}
            marks = MARKS & parts
            if not marks or NOT_MARKS & parts:
                continue
            whole = all(p in MARKS or p in BOX or p.isdigit() for p in parts)
            strong = STRONG & marks
            if key == "class" and strong:  # "post-comments"
                whole = whole or all(
                    p in MARKS or p in BOX or p in OF_CONTENT or p.isdigit() for p in parts
                )
            first = min(marks)
            if name in HEADINGS:
                found.setdefault("soft", first)
            elif key == "role" or whole and strong:
                return "other", min(strong, default=first)
            elif whole and (key == "id" or marks <= MAYBE):
                found.setdefault("maybe", first)
            elif key == "id" or "header" in marks and OF_CONTENT & parts:
                found.setdefault("soft", first)
            else:
                found.setdefault("maybe" if marks <= MAYBE else "box", first)
    return next(((grade, found[grade]) for grade in ("box", "maybe", "soft") if grade in found), None)


class Elements:
    """Where elements end, by the depth of their name, and where content begins."""

    def __init__(self, source: str):
        self.source = source
        self.content = [m.start() for m in _CONTENT_START.finditer(source)]
        self._ends: dict[int, int] | None = None

    def end(self, start: int) -> int:
        """Where the end tag of the element that starts there begins, or the page's end."""
        if self._ends is None:  # all in one pass, when first asked for
            self._ends = {}
            opened: dict[str, list[int]] = defaultdict(list)
            for m in _TAG_START.finditer(self.source):
                own = opened[m[2].lower()]
                if not m[1]:
                    own.append(m.start())
                elif own:
                    self._ends[own.pop()] = m.start()
        return self._ends.get(start, len(self.source))

    def holds_content(self, start: int) -> bool:
        """True if labelled content begins inside the element."""
        at = bisect_right(self.content, start)
        return at < len(self.content) and self.content[at] < self.end(start)

    def holds_most(self, start: int) -> bool:
        """True if the element is more than half of the page."""
        return 2 * (self.end(start) - start) > len(self.source)


class Page:
    """Tokens of a page in order: kind, score count, and text where it is a word run."""

    def __init__(self, source: str):
        self.kinds: list[str] = []
        self.counts: list[int] = []
        self.texts: list[str | None] = []
        self.labelled: list[bool] = []  # inside an article or main element
        self.boxes: dict[int, tuple[int, bool]] = {}  # first token: end, and whether it is a maybe
        self._read(source)

    def _add(self, kind: str, count: int, text: str | None, inside: bool) -> None:
        self.kinds.append(kind)
        self.counts.append(count)
        self.texts.append(text)
        self.labelled.append(inside)

    def _read(self, source: str) -> None:
        stack: list[str] = []
        open_boxes: list[tuple[int, int, bool]] = []  # depth of the stack, first token, maybe

        def end_boxes() -> None:
            while open_boxes and len(stack) < open_boxes[-1][0]:
                _, first, maybe = open_boxes.pop()
                self.boxes[first] = (len(self.kinds), maybe)

        skip = 0  # depth of the stack at which an element that is no content began
        inside = linked = 0
        at, size = 0, len(source)
        # An element around the labelled content is never left out.
        elements = Elements(source)
        opened: Counter[str] = Counter()  # names in the stack
        while at < size:
            m = _TOKEN.match(source, at)
            begin, at = at, m.end()
            text = m["text"]
            if text is not None:
                if not skip:
                    text = html.unescape(text) if "&" in text else text
                    count = len(text.split())
                    self._add(LINKED if linked else WORD, count, text, inside > 0)
                continue
            name = m["name"] or m["name2"]
            if name is None:
                continue
            name = name.lower()
            if m["close"] or m["close2"]:
                if not opened[name]:
                    continue
                skipped = skip
                while stack:
                    top = stack.pop()
                    opened[top] -= 1
                    inside -= top in CONTENT
                    linked -= top == "a"
                    if skip and len(stack) < skip:
                        skip = 0
                    if top == name:
                        break
                if not skipped:
                    self._tag(name, inside > 0)
                end_boxes()
                continue
            rest = m["rest"] if m["rest"] is not None else m["rest2"] or ""
            if name in RAW:
                at = self._raw_end(source, name, at)
                continue
            if name in VOID:
                if not skip:
                    self._tag(name, inside > 0)
                continue
            closes = "p" if name in ENDS_P else name if name in ENDS_SAME else None
            if closes and stack and stack[-1] == closes:
                opened[stack.pop()] -= 1
                if skip and len(stack) < skip:
                    skip = 0
                end_boxes()
            if rest.endswith("/") and name not in ENDS_P:
                if not skip:
                    self._tag(name, inside > 0)
                continue
            stack.append(name)
            opened[name] += 1
            inside += name in CONTENT
            linked += name == "a"
            if skip:
                continue
            grade, said = mark(name, rest) or (None, None)
            if name == "form" and grade and elements.holds_most(begin):
                grade = None  # a page that is one form as a whole
            if grade and not elements.holds_content(begin):
                if grade == "other":
                    skip = len(stack)
                elif grade != "soft":
                    open_boxes.append((len(stack), len(self.kinds), grade == "maybe"))
                if grade != "soft" or name not in INLINE:
                    self._add(f"other {said}", 1, None, inside > 0)
                    continue
            self._tag(name, inside > 0)
        stack.clear()
        end_boxes()

    @staticmethod
    def _raw_end(source: str, name: str, at: int) -> int:
        m = _RAW_END[name].search(source, at)
        if m is None:
            if name == "head":  # a head left open ends where the body begins
                m = _BODY.search(source, at)
                return m.start() if m else at
            return len(source)
        end = source.find(">", m.end())
        return len(source) if end < 0 else end + 1

    def _tag(self, name: str, inside: bool) -> None:
        text = None if name in INLINE and name not in SPACE else ("" if name not in SPACE else " ")
        self._add(f"tag {name}" if name in _KNOWN else "tag ?", 1, text, inside)

    def _best(
        self, weights: dict[str, float], first: int, end: int, opened: set[int]
    ) -> tuple[float, tuple[int, int]]:
        """Highest sum of a contiguous run, and its first token and end.

        A box that is not opened counts as its first token.
        """
        best, span = 0.0, (first, first)
        total, start = 0.0, first
        i = first
        while i < end:
            if total <= 0:
                total, start = 0.0, i
            total += weights.get(self.kinds[i], PRIOR_TAG) * self.counts[i]
            after = self.boxes[i][0] if i in self.boxes and i not in opened else i + 1
            if total > best:
                best, span = total, (start, after)
            i = after
        return best, span

    def _closed(self, first: int, end: int, opened: set[int]) -> list[int]:
        """Boxes of a run that are not opened, without those inside another."""
        out: list[int] = []
        for i in sorted(i for i in self.boxes if first <= i < end and i not in opened):
            if not out or i >= self.boxes[out[-1]][0]:
                out.append(i)
        return out

    def _opened(self, weights: dict[str, float]) -> set[int]:
        """Boxes whose words are read."""
        opened: set[int] = set()
        while self.boxes:
            best, (first, end) = self._best(weights, 0, len(self.kinds), opened)
            more = set()
            for i in self._closed(0, len(self.kinds), opened):
                after, maybe = self.boxes[i]
                own = weights.get(self.kinds[i], PRIOR_TAG)
                own += self._best(weights, i + 1, after, opened)[0]
                if own > best or maybe and own > 0 and first <= i and after <= end:
                    more.add(i)
            if not more:
                break
            opened |= more
        return opened

    def region(self, weights: dict[str, float]) -> tuple[int, int]:
        """First token and end of the contiguous run with the highest sum; empty if none."""
        return self._best(weights, 0, len(self.kinds), self._opened(weights))[1]

    def text(self, weights: dict[str, float]) -> str:
        opened = self._opened(weights)
        first, end = self._best(weights, 0, len(self.kinds), opened)[1]
        blocks: list[str] = []
        held: list[str] = []
        i = first
        while i < end:
            kind, text = self.kinds[i], self.texts[i]
            if kind in (WORD, LINKED):
                held.append(text)
            elif text == " ":
                held.append(" ")
            elif text == "" or kind.startswith("other"):
                blocks.append(" ".join("".join(held).split()))
                held = []
            i = self.boxes[i][0] if i in self.boxes and i not in opened else i + 1
        blocks.append(" ".join("".join(held).split()))
        return "\n\n".join(block for block in blocks if block)

    def outside_boxes(self) -> list[int]:
        """Tokens that are in no box, and the first of each."""
        out, i = [], 0
        while i < len(self.kinds):
            out.append(i)
            i = self.boxes[i][0] if i in self.boxes else i + 1
        return out


_KNOWN = set(TAGS)


def learn_weights(pages: DataFrame, html_column: str = "html") -> dict[str, float]:
    """Log odds of each kind of token to lie inside, over all pages that label their content.

    The counts are a few hundred numbers whatever the number of pages.
    """
    picked = pages.select(pages[html_column].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for _, group in by_bytes(batches, "html", GROUP_BYTES):
            for source in group:
                page = Page(source.decode("utf-8"))
                if not any(page.labelled):
                    continue
                for i in page.outside_boxes():
                    side = 0 if page.labelled[i] else 1
                    counts.setdefault(page.kinds[i], [0, 0])[side] += page.counts[i]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(counts), pa.string()),
                pa.array([c[0] for c in counts.values()], pa.int64()),
                pa.array([c[1] for c in counts.values()], pa.int64()),
            ],
            names=["kind", "inside", "outside"],
        )

    rows = map_arrow(picked, run, "kind string, inside long, outside long")
    totals = rows.groupBy("kind").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside")
    )
    weights = dict(PRIOR)
    weights |= {
        f"tag {name}": PRIOR_INLINE if name in INLINE else PRIOR_TAG for name in [*TAGS, "?"]
    }
    weights |= {f"other {name}": PRIOR_OTHER for name in [*OTHER, *MARKS, "marked"]}
    for row in totals.collect():
        kind = row["kind"]
        odds = math.log((row["inside"] + 1) / (row["outside"] + 1))
        low, high = (
            WORD_RANGE
            if kind == WORD
            else LINKED_RANGE
            if kind == LINKED
            else OTHER_RANGE
            if kind.startswith("other")
            else TAG_RANGE
        )
        weights[kind] = float(np.clip(odds, low, high))
    return weights


def extract(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Id, url, ``text`` and ``n_chars`` of every page."""
    weights = learn_weights(pages, html_column)
    picked = pages.select(
        pages[id_column].alias("id"), pages[url_column].alias("url"), pages[html_column].alias("html")
    )
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in by_bytes(batches, "html", GROUP_BYTES):
            texts = [Page(source.decode("utf-8")).text(weights) for source in group]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["id", "url", "text", "n_chars"],
            )

    schema = f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long"
    found = map_arrow(picked, run, schema)
    return found.withColumnsRenamed({"id": id_column, "url": url_column})


def op2_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract(table(spark, sf, "pages"))
