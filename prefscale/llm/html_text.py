"""Main text of web pages by tree scoring.

A page is read into a tree that forgives unclosed and misplaced tags. Runs of inline content are blocks. Every block
of some length passes points for its length and its commas to its ancestors, less with each level, discounted by the
share of its characters that stand in links. The container with the most points, and those of its siblings that look
like text, are kept; an enclosing article or main element takes the place of a container inside it. Menus, page
headers, footers, sidebars, notices, adverts, forms, scripts, comments of readers and hidden elements are never read.

A class or id tells a part that isn't read by its words: some do wherever they stand (sidebar, newsletter), others only
alone or among words of layout, so that "social-links" is such a part and "social-history" isn't.

Cases. A null or empty page has an empty text; so has one without text outside those parts. Pages of any length and
depth are read whole, in time linear in both. Of containers with equal points the first wins. Repeated rows are read
each for itself; other columns pass unread, and one with the name of the result is replaced. An empty table gives no
rows.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg math object audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr caption ul".split()
)
DROPPED = frozenset("head nav footer aside form fieldset button select option optgroup dialog menu search input label".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
TAG_POINTS = {"article": 15, "main": 12, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "address": -3, "th": -5}

# Words of class names and ids of parts that aren't read, wherever they stand in a name,
ALWAYS = frozenset(
    "sidebar advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion "
    "breadcrumb breadcrumbs masthead navbar footnav commentlist disqus cookie cookies consent gdpr popup modal newsletter "
    "subscribe subscription pagination pager outbrain taboola topbar".split()
)
# alone or among words of layout,
SOMETIMES = frozenset(
    "ad ads banner side menu menus nav navigation footer foot comment comments respond reply replies notice notices alert "
    "overlay signup login share sharing social related recommend recommended recommendations widget widgets toolbar skip".split()
)
# the same outside articles only,
HEADS = frozenset("header head".split())
# and the words of layout.
LAYOUT = frozenset(
    "link links list lists box boxes bar bars wrap wrapper container inner outer left right top bottom area section block "
    "blocks panel item items button buttons icon icons form title global primary secondary mobile site page user users "
    "reader readers post posts article articles story stories news media slot unit row col column thread group id to main".split()
)
_GOOD = re.compile(r"article|body|content|entry|main|post|story|text|blog", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|"
    r"<([A-Za-z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")
_ENDS: dict[str, re.Pattern] = {}

LEAST_CHARS = 25


def _end_of(name: str) -> re.Pattern:
    if name not in _ENDS:
        _ENDS[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)
    return _ENDS[name]


def attributes_of(source: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, the first of each; one without a value is empty."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def unread(names: str, inside: bool = False) -> bool:
    """Whether a class or an id among names tells a part that isn't read; inside: of an article."""
    for name in names.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if not ALWAYS.isdisjoint(parts):
            return True
        told = SOMETIMES if inside else SOMETIMES | HEADS
        if not told.isdisjoint(parts) and all(p in told or p in LAYOUT for p in parts):
            return True
    return False


class _Page:
    """Nodes in order of their start, so that a parent's number is below its children's."""

    def __init__(self, source: str):
        self.tag, self.parent, self.dropped, self.names = ["#root"], [0], [False], [""]
        #: (block node, text, characters in links) of each run of inline content, in page order.
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._parts, self._owner, self._links, self._in_link = [0], [], 0, 0, 0
        self._opened: Counter[str] = Counter()  # elements on the stack by tag
        self._read(source)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._owner, text, self._links))
            self._parts, self._links = [], 0

    def _text(self, raw: str) -> None:
        top = self._stack[-1]
        if self.dropped[top] or not raw:
            return
        text = _html.unescape(raw) if "&" in raw else raw
        if not self._parts:
            if text.isspace():
                return
            self._owner = next((k for k in reversed(self._stack) if self.tag[k] in BLOCK), 0)
        self._parts.append(text)
        if self._in_link:
            self._links += len(" ".join(text.split()))

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            k = self._stack.pop()
            self._opened[self.tag[k]] -= 1
            self._in_link -= self.tag[k] == "a"
            if self.tag[k] in BLOCK:
                self._flush()

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._flush()
            for d in range(len(self._stack) - 1, 0, -1) if self._opened["p"] else ():  # a block ends an open paragraph
                t = self.tag[self._stack[d]]
                if t == "p":
                    self._pop_to(d)
                    break
                if t in BLOCK and t not in HEADINGS:
                    break
            if tag in CLOSES:
                closed, walls = CLOSES[tag]
                for d in range(len(self._stack) - 1, 0, -1) if any(self._opened[t] for t in closed) else ():
                    t = self.tag[self._stack[d]]
                    if t in walls:
                        break
                    if t in closed:
                        self._pop_to(d)
                        if tag not in ("tr", "tbody"):
                            break
        elif tag == "a" and self._in_link:
            for d in range(len(self._stack) - 1, 0, -1):
                if self.tag[self._stack[d]] == "a":
                    self._pop_to(d)
                    break
        if tag == "br":
            if self._parts:
                self._parts.append(" ")
            return
        if tag in VOID:
            return
        up = self._stack[-1]
        names, drop = "", self.dropped[up] or tag in DROPPED
        if not drop and attributes:
            own = attributes_of(attributes)
            names = f"{own.get('class', '')} {own.get('id', '')}".strip()
            drop |= own.get("role", "").strip().lower() in DROPPED_ROLES or bool(_HIDDEN.search(own.get("style", "")))
            drop |= "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true"
            if names and (tag not in ("body", "html", "article", "main", "p") or "comment" in names.lower()):
                drop |= unread(names, tag not in ("div", "section", "table") or self._inside())
        if not drop and tag == "header":
            drop = not self._inside()
        k = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.dropped.append(drop)
        self.names.append(names)
        self._stack.append(k)
        self._opened[tag] += 1
        self._in_link += tag == "a"

    def _inside(self) -> bool:
        return self._opened["article"] + self._opened["main"] > 0

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                lt = n
            m = _TOKEN.match(s, lt) if lt < n else None
            if m is None:  # a lone < is text
                self._text(s[at : lt + 1] if lt < n else s[at:])
                at = lt + 1
                continue
            if lt > at:
                self._text(s[at:lt])
            at = m.end()
            if m[1] is not None:
                self._text(m[1])
            elif m[2]:
                tag = m[2].lower()
                for d in range(len(self._stack) - 1, 0, -1) if self._opened[tag] else ():
                    t = self.tag[self._stack[d]]
                    if t == tag:
                        self._pop_to(d)
                        break
                    if tag not in BLOCK and t in BLOCK:  # an inline end doesn't close blocks
                        break
                    if t in ("td", "th", "table") and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "body", "html"):
                        break
            elif m[3] or m[5]:
                tag, attributes = (m[3] or m[5]).lower(), m[4] if m[3] else m[6]
                if tag in RAW and not attributes.endswith("/"):
                    end = _end_of(tag).search(s, at)
                    at = end.end() if end else n
                else:
                    self._open(tag, attributes)
        self._pop_to(1)
        self._flush()


def _chain(page: _Page, k: int) -> Iterator[int]:
    while k:
        yield k
        k = page.parent[k]


#: What a block's points are divided by, by the levels between it and an ancestor; the last for all beyond.
LEVELS = (1, 2, 6, 9, 12, 15, 18)


def _points(page: _Page) -> tuple[list[float], list[int], list[int], list[int]]:
    """Points, blocks that count, characters and characters in links of every node, passed up from children to parents:
    as a parent's number is below its children's, one pass from the last node does."""
    n, far = len(page.tag), len(LEVELS) - 1
    level = [[0.0] * n for _ in LEVELS]  # points of what lies so many levels below
    counted, chars, links = [0] * n, [0] * n, [0] * n
    for owner, text, linked in page.blocks:
        chars[owner] += len(text)
        links[owner] += linked
        if len(text) < LEAST_CHARS or page.tag[owner] in HEADINGS:
            continue
        if page.tag[owner] in ("p", "pre", "td", "blockquote", "li", "dd"):
            owner = page.parent[owner]
        level[0][owner] += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(1, linked / len(text)))
        counted[owner] += 1
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        if chars[k] or counted[k]:
            for d in range(far):
                level[d + 1][up] += level[d][k]
            level[far][up] += level[far][k]
            counted[up] += counted[k]
            chars[up] += chars[k]
            links[up] += links[k]
    return [sum(level[d][k] / LEVELS[d] for d in range(far + 1)) for k in range(n)], counted, chars, links


def _down(page: _Page, first: set[int]) -> list[int]:
    """For every node, the one of ``first`` that it is or lies in, the nearest; 0 for none."""
    out = [0] * len(page.tag)
    for k in range(1, len(out)):
        out[k] = k if k in first else out[page.parent[k]]
    return out


def main_text(source: str | None) -> str:
    page = _Page(source or "")
    if not page.blocks:
        return ""
    score, counted, chars, links = _points(page)
    density = lambda k: links[k] / max(1, chars[k])

    def total(k: int) -> float:
        weight = 25 * bool(_GOOD.search(page.names[k])) if page.names[k] else 0
        return (score[k] + TAG_POINTS.get(page.tag[k], 0) + weight) * (1 - density(k))

    totals = {k: total(k) for k in range(1, len(page.tag)) if counted[k] and page.tag[k] != "html"}
    if totals:
        best = max(totals, key=lambda k: (totals[k], -k))
    else:
        with_text = [k for k in range(1, len(page.tag)) if chars[k]]
        best = min([k for k in with_text if page.tag[k] in ("article", "main")] or with_text, default=0)
    article = next((k for k in _chain(page, best) if page.tag[k] in ("article", "main")), None)
    top = article or best
    roots = {top}
    if best and page.tag[best] != "body":
        level = _down(page, {k for k in range(1, len(page.tag)) if page.parent[k] == page.parent[top]})
        for k in {level[b[0]] for b in page.blocks} - {0, top}:
            same = page.names[k] and page.names[k] == page.names[top]
            near = totals.get(k, 0) + (0.2 * totals.get(top, 0) if same else 0) >= max(10, 0.2 * totals.get(top, 0))
            if near and page.tag[k] not in HEADINGS or page.tag[k] == "p" and (chars[k] > 80 and density(k) < 0.25):
                roots.add(k)
        if article is None:
            before = [k for k in {b[0] for b in page.blocks} if page.tag[k] in ("h1", "h2") and page.parent[k] == page.parent[top] and k < top]
            roots |= {max(before)} if before else set()
    if roots == {0}:
        return "\n".join(t for _, t, _ in page.blocks)
    inside = _down(page, roots)
    return "\n".join(t for owner, t, _ in page.blocks if inside[owner])


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text of each; the html is dropped, other columns pass unread."""
    out = pages.drop(into).withColumn(into, F.lit("")).drop(column) if column != into else pages
    names = out.columns
    src = pages.select(column, *(c for c in names if c != into))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, column, 8 << 20):
                texts = pa.array([main_text(h) for h in part.column(column).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if c == into else part.column(c) for c in names], names=names)

    return src.mapInArrow(read, out.schema)


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
