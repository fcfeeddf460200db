"""Main text of web pages by composite text density (operator 9).

Every element of a page gets a density: characters per tag, lowered by its links
in relation to those of the whole page. The element whose children's densities
have the largest sum holds the article; the lowest density on the path from
there up to the body is the threshold that further elements must reach.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.llm.common import slices

# Names of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head title script style noscript template nav footer aside form iframe button input select textarea svg canvas "
    "object embed audio video dialog menu datalist map".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that opens ends an open one of these, up to the nearest of the second set.
ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot tr td th", "table"),
    "tbody": ("thead tbody tfoot tr td th", "table"),
    "tfoot": ("thead tbody tfoot tr td th", "table"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
HOLDS_P = frozenset("article aside blockquote body div footer form header li main nav section table td th".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
#: Parts of class names and ids that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner "
    "banners cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login sidebar sidebars widget widgets rail menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead topbar toolbar related recommended recommendations share sharing social "
    "pagination pager search form skip copyright legal".split()
)
#: What a head can hold; anything else ends it, as its end tag may be left out.
IN_HEAD = frozenset("head title base basefont bgsound link meta script style noscript noframes template".split())
#: Elements that stray end tags do not leave, and elements whose end tags do.
CLOSED = ("article", "main", "body", "td")
FRAMES = frozenset("body html main article div section table tr".split())
#: Parts of names that say nothing about what an element holds: next to a mark they leave it one.
LAYOUT = frozenset(
    "bar block box btn button buttons card cards col column container content group icon icons inner item items links "
    "list main media module outer panel post posts article articles stories story row section site slot text title "
    "top bottom left right unit wrap wrapper area page primary secondary the and for".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
_PART = re.compile(r"[a-z]+")
_ABOUT_LAYOUT = re.compile(r"(has|with|without|no|is|js|can)[-_]")


class _Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "chars", "tags", "link_chars", "links", "density", "total", "out")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list = []  # texts and elements, in order
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0
        self.out = False

    def children(self) -> list[_Node]:
        return [x for x in self.parts if type(x) is _Node]


class _Page(HTMLParser):
    """Tree of a page; elements that were never closed end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", {}, None)
        self.open = [self.root]
        self.nodes = [self.root]  # parents before children
        self.places: dict[str, list[int]] = {}  # of open elements below the root, by name

    def _last(self, tags) -> int:
        """Place of the innermost open element of these names, 0 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close(self, place: int) -> None:
        for node in self.open[place:]:
            self.places[node.tag].pop()
        del self.open[place:]

    def _end(self, tags: frozenset, within: frozenset) -> None:
        place = self._last(tags)
        if place and place >= self._last(within):
            self._close(place)

    def _end_head(self, tag: str) -> None:
        """End a head that is still open; what ends it is in the body, with or without a start tag."""
        if len(self.open) < 2 or self.open[1].tag != "head" or tag != "body" and any(n.tag != "title" for n in self.open[2:]):
            return
        self._close(1)
        if tag != "body" and not any(n.tag == "body" for n in self.nodes):
            self._add("body", {})

    def _add(self, tag: str, attrs: dict) -> None:
        node = _Node(tag, attrs, self.open[-1])
        self.open[-1].parts.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        if tag == "body" or tag in BLOCK and tag != "html" or self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._end_head(tag)
        if tag in ENDS:
            for _ in range(3):
                self._end(*ENDS[tag])
        if tag in BLOCK:
            self._end(frozenset(("p",)), HOLDS_P)
        self._add(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        place = self._last((tag,))
        # An end tag does not reach out of the article, unless it is of a frame itself.
        if place and (tag in FRAMES or place >= self._last(CLOSED)):
            self._close(place)

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._end_head("")
        self.open[-1].parts.append(data)

    def wrap_loose(self) -> None:
        """Make each run of text and inline elements directly in the body a paragraph, to be weighed like one."""
        body = next((n for n in self.nodes if n.tag == "body"), None)
        if body is None:
            return
        parts: list = []
        made: list[_Node] = []
        run: list = []
        for part in [*body.parts, None]:
            if part is not None and (type(part) is str or part.tag not in BLOCK and part.tag not in DROPPED):
                run.append(part)
                continue
            if any(type(x) is str and x.strip() for x in run):
                made.append(_Node("p", {}, body))
                made[-1].parts = run
                for x in run:
                    if type(x) is _Node:
                        x.parent = made[-1]
                run = made[-1:]
            parts += run if part is None else [*run, part]
            run = []
        body.parts = parts
        at = self.nodes.index(body) + 1
        self.nodes[at:at] = made


def _parsed(html: str) -> _Page:
    """Tree of a page, with its loose text in paragraphs."""
    page = _read(html)
    page.wrap_loose()
    return page


def _read(html: str) -> _Page:
    page = _Page()
    try:
        page.feed(html)
        page.close()
    except AssertionError:  # a broken declaration
        page = _Page()
        page.feed(re.sub(r"<!(?!--)[^>]*>?", " ", html))
        page.close()
    return page


def _named(node: _Node, words: frozenset) -> bool:
    for value in (node.attrs.get("class", ""), node.attrs.get("id", "")):
        for name in value.lower().split():
            if not _ABOUT_LAYOUT.match(name) and not words.isdisjoint(_PART.findall(name)):
                return True
    return False


def _named_wholly(node: _Node, words: frozenset) -> bool:
    """A name all of whose parts are marks or layout: ``related-posts``, but not ``related-work``."""
    for value in (node.attrs.get("class", ""), node.attrs.get("id", "")):
        for name in value.lower().split():
            parts = _PART.findall(name)
            if not _ABOUT_LAYOUT.match(name) and not words.isdisjoint(parts) and (words | LAYOUT).issuperset(parts):
                return True
    return False


def _is_dropped(node: _Node, in_article: bool, holds_article: bool, frames: bool) -> bool:
    """``frames``: a form that may be around the whole page, and is not dropped for being one."""
    tag = node.tag
    if tag in DROPPED and not (tag == "form" and frames):
        return True
    if tag in ("html", "body", "main"):
        return False
    if "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", node.attrs.get("style", "")):
        return True
    # Within the article a chapter may be about what a mark means elsewhere.
    named = _named_wholly if in_article else _named
    if named(node, COMMENTS):
        return not holds_article
    if tag == "article" or holds_article:
        return False
    if tag == "header":
        return not in_article
    if tag in HEADINGS:
        return False
    if tag == "form":
        return node.attrs.get("role", "") == "search" or named(node, MARKS - {"form"})
    return node.attrs.get("role", "") in ROLES or named(node, MARKS)


def _mark(nodes: list[_Node], inside: set, holds: set, forms: set) -> None:
    """Mark what is dropped; of forms, all but ``forms`` are."""
    for node in nodes:
        parent = node.parent
        node.out = parent is not None and (parent.out or _is_dropped(node, node in inside, node in holds, node in forms))


def _measure(page: _Page) -> None:
    """Mark what is dropped, then count and weigh the rest, children before parents."""
    nodes = page.nodes
    holds = set()
    for node in reversed(nodes):
        if node.tag in ("article", "main") and not _named(node, COMMENTS) or node in holds:
            if node.parent is not None:
                holds.add(node.parent)
    inside = set()
    for node in nodes:
        parent = node.parent
        if parent is not None and (parent in inside or parent.tag in ("article", "main")):
            inside.add(node)
    forms = {n for n in nodes if n.tag == "form"}
    _mark(nodes, inside, holds, forms)
    if forms:
        # Only a form that holds the article, or most of the text there is with all forms, stays.
        chars: dict[_Node, int] = {}
        for node in reversed(nodes):
            if not node.out:
                own = sum(len("".join(x.split())) if type(x) is str else chars.get(x, 0) for x in node.parts)
                chars[node] = own
        most = chars.get(page.root, 0)
        stay = {n for n in forms if n in holds or 0 < most <= 2 * chars.get(n, 0)}
        _mark(nodes, inside, holds, stay)
    for node in reversed(nodes):
        if node.out:
            continue
        for part in node.parts:
            if type(part) is str:
                node.chars += len("".join(part.split()))
            elif not part.out:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.links += part.links + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    root = page.root
    page_links = root.link_chars / max(1, root.chars)
    for node in nodes:
        node.density = 0.0 if node.out else _density(node, page_links)
    for node in nodes:
        node.total = sum(c.density for c in node.children())


def _density(node: _Node, page_links: float) -> float:
    if not node.chars:
        return 0.0
    tags, links = max(1, node.tags), max(1, node.links)
    plain = max(1, node.chars - node.link_chars)
    ratio = node.chars / max(1, node.link_chars) * tags / links
    base = math.log(node.chars / plain * node.link_chars + page_links * node.chars + math.e)
    # Without any link on the page the base is one for all elements alike.
    return node.chars / tags * math.log(max(1.0, ratio)) / (math.log(base) if base > 1 else 1.0)


def _selected(page: _Page) -> tuple[_Node, set[_Node]]:
    """The element that frames the article, and the dense elements in it."""
    body = next((n for n in page.nodes if n.tag == "body"), page.root)
    # The root is no choice next to a body: it holds the same text.
    best = max((n for n in page.nodes if not n.out and (n is not page.root or n is body)), key=lambda n: n.total, default=body)
    if best is body:
        # An article with most of the text goes before what stands beside it.
        main = [n for n in page.nodes if n.tag in ("article", "main") and _plain(n, 0.0) and 2 * n.chars >= body.chars]
        if not main:
            return body, {body}
        best = max(main, key=lambda n: n.total)
    elif best.total <= 0:
        return body, {body}
    threshold, up = best.density, best
    while up is not None:
        if up.density < threshold:
            threshold = up.density
        up = up.parent if up is not body else None
    # The article or main element around the best one frames it.
    frame, up = None, best
    while up is not None:
        if up.tag in ("article", "main"):
            frame = up
            if up.tag == "article":
                break
        up = up.parent
    if frame is not None and frame.tag == "main":
        held = [n for n in page.nodes if n.tag == "article" and _plain(n, 0.0) and _holds(frame, n)]
        largest = max(held, key=lambda n: n.chars, default=frame)
        frame = largest if 2 * largest.chars >= frame.chars else frame
    if frame is not None:
        return _widened(frame, threshold)
    # Else whatever is as dense as the sparsest element on the body's path.
    dense = {best}
    for node in page.nodes:
        if node.out or node is body or node is page.root:
            continue
        # A heading is no text of its own: it goes with what it stands over.
        if node.parent in dense or node.tag not in HEADINGS and _plain(node, threshold):
            dense.add(node)
    return body, dense


def _plain(node: _Node, threshold: float) -> bool:
    return not node.out and node.chars > 0 and node.density >= threshold and 2 * node.link_chars < node.chars


def _widened(frame: _Node, threshold: float) -> tuple[_Node, set[_Node]]:
    """The article's frame, or the main element around it if more of that is dense.

    Other articles there, and text before the article (a title, a lead), belong
    to the page's text where they are as dense as the path to the body.
    """
    main = frame.parent
    while main is not None and main.tag != "main":
        main = main.parent
    if frame.tag != "article" or main is None:
        return frame, {frame}
    dense, before, work = {frame}, True, list(reversed(main.children()))
    while work:
        node = work.pop()
        if node is frame:
            before = False
        elif node.out:
            continue
        elif _holds(node, frame):
            work.extend(reversed(node.children()))
        elif node.tag == "article" or before and node.tag in BLOCK and node.tag not in HEADINGS:
            if _plain(node, threshold):
                dense.add(node)
        elif node.tag in BLOCK:
            work.extend(reversed(node.children()))
    return (main, dense) if len(dense) > 1 or _titled(main, frame) else (frame, {frame})


def _holds(node: _Node, inner: _Node) -> bool:
    while inner is not None and inner is not node:
        inner = inner.parent
    return inner is node


def _titled(main: _Node, frame: _Node) -> bool:
    """Whether a heading stands before the article on its path within main."""
    up = frame
    while up is not main:
        for node in up.parent.children():
            if node is up:
                break
            if node.tag in HEADINGS and not node.out:
                return True
        up = up.parent
    return False


def _headed(frame: _Node, dense: set[_Node]) -> set[_Node]:
    """Elements that hold something taken: their own headings are taken, too."""
    holding = set()
    for node in dense:
        while node is not None and node not in holding:
            holding.add(node)
            node = node.parent if node is not frame else None
    return holding


def main_text(html: str | None) -> str:
    """The article of one page; empty if it has none."""
    page = _parsed(html or "")
    _measure(page)
    frame, dense = _selected(page)
    whole = frame in dense
    holding = _headed(frame, dense)
    out: list[str] = []
    work: list = [(frame, whole)]
    while work:
        part, taken = work.pop()
        if type(part) is str:
            if taken:
                out.append(part)
            continue
        if part is None:
            out.append(" ")
            continue
        if part.out:
            continue
        taken = taken or part in dense or part.tag in HEADINGS and part.parent in holding
        if part.tag in BLOCK or part.tag == "br":
            out.append(" ")
            work.append((None, False))
        work.extend((x, taken) for x in reversed(part.parts))
    return " ".join("".join(out).split())


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The whole html is read; null counts as empty and gives an empty text. White
    space inside a block becomes one space, blocks are joined in page order by one
    space. Without html there is no text; with text but no dense element all of the
    body that is not dropped counts. Broken markup is read as far as browsers would:
    open elements end with their parents. Other columns are not read.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = [main_text(h) for h in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("page_id"),
                        piece.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array(np.array([len(t) for t in texts], dtype=np.int64)),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
