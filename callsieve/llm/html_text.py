"""Main text of web pages: parser events, text-to-tag ratios, smoothed clusters.

1. The page goes through the standard library's event parser in pieces. Events
   become lines: the text between two starts or ends of block elements, with
   the tags seen in it, the containers around it, and the parts of a page (menus,
   forms, asides, elements named like adverts or comments) that it is in.
2. Each line has a text-to-tag ratio. The ratios of all lines are smoothed with a Gaussian
   and split in two clusters by threshold; the upper one marks the content.
3. Clusters choose, elements bound. A part does not count as the article, unless it holds
   long text and far more content than all the rest: then it was named or nested wrongly. The
   region is the ``article`` and ``main`` elements that share most of the content, or
   else the innermost container that holds it; long clusters outside belong to it too.
   All lines of the region are kept: a short paragraph between long ones, or a heading,
   is part of the article.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.llm.workers import map_arrow

#: Fixed values of HTML: elements without content, and elements that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("html body main article section div td center blockquote".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never read, and those that are parts of a page beside its article.
UNREAD = frozenset(
    "head script style noscript template svg math canvas object iframe audio video map button select textarea label".split()
)
APART = frozenset("nav header footer aside form fieldset dialog menu search".split())
ROLE_APART = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()
)
#: Words of ``class`` and ``id`` that name such parts.
NAME_APART = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner "
    "banners cookie cookies consent gdpr notice notices notification notifications popup modal overlay sidebar sidebars "
    "aside rail menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus "
    "respond replies reply share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login signin pagination pager toolbar widget widgets copyright disclaimer skip alert outbrain taboola".split()
)
COMMENT_APART = frozenset("comment comments disqus respond replies reply".split())
#: Words that say nothing of their own in a name; a name with any other word ("share-price") is no such part.
NEUTRAL = frozenset(
    "a the of user users site page post main top bottom left right box block wrap wrapper container section area bar inner outer "
    "list item items content text link links title body group panel module unit slot icon icons button buttons btn form js".split()
)
#: Beside such words the others tell of the page around the element ("has-sidebar").
NOT_APART = frozenset("has with no without free".split())
#: Elements of text: their ``id`` is an anchor, not a name.
TEXT_BLOCK = frozenset("p li dd dt blockquote pre h1 h2 h3 h4 h5 h6 td th tr caption figcaption".split())
SIGMA = 1.0
#: Of all content: what a container must hold, what ``article`` elements must hold together.
SHARE, MOST = 0.9, 0.5
#: Of the largest article's content: what another article, or a cluster outside, must have to belong to it.
LIKE = 0.2
#: Characters of content from which a cluster is long; how many times the rest a part must have to count after all.
LONG_TEXT, OUTVOTES = 500, 2.0
#: Clusters are two if the mean ratios are apart by this factor.
APART_BY = np.log(4)
PIECE = 1 << 16


class _Node:
    """An open element; ``parts`` are the parts of the page that it is in, the outermost first."""

    __slots__ = ("tag", "parent", "unread", "parts", "depth", "in_article", "number", "mass", "inside")

    def __init__(self, tag: str, parent: "_Node | None", kind: str | None = None, number: int = 0):
        self.tag, self.parent, self.number = tag, parent, number
        self.unread = kind == "unread" or (parent is not None and parent.unread)
        self.parts: tuple[_Node, ...] = parent.parts if parent else ()
        if kind == "part" and len(self.parts) < 8:
            self.parts += (self,)
        self.depth = parent.depth + 1 if parent else 0
        self.in_article = tag == "article" or (parent is not None and parent.in_article)
        self.mass = 0
        self.inside: bool | None = None

    @property
    def apart(self) -> bool:
        return self.unread or bool(self.parts)


class _Line:
    __slots__ = ("text", "tags", "node", "parts", "heading")

    def __init__(self, text: str, tags: int, node: _Node, parts: tuple[_Node, ...], heading: bool):
        self.text, self.tags, self.node, self.parts, self.heading = text, tags, node, parts, heading


def _words_of(name: str) -> set[str]:
    """The words of one class or id: at hyphens, underscores, digits and capitals."""
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))


class PageLines(HTMLParser):
    """Lines of a page, from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self._nodes = 0
        self._open = _Node("#", None)
        self._text: list[str] = []
        self._tags = 1

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text and not self._open.unread:
            heading = False
            at: _Node | None = self._open
            while at is not None and at.tag not in CONTAINER and at.tag not in APART:
                heading = heading or at.tag == "h1"
                at = at.parent
            self.lines.append(_Line(text, self._tags, at or self._open, self._open.parts, heading))
        self._tags = 1

    def _kind(self, tag: str, attrs: dict[str, str | None]) -> str | None:
        """Whether an element is not read, a part beside the article, or neither."""
        if tag in ("html", "body", "main"):
            return None
        in_article = self._open.in_article
        if tag in UNREAD or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return "unread"
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.I):
            return "unread"
        part = "part" if tag in BLOCK else "unread"  # within a line it has no line of its own
        if tag == "header" and in_article:
            return None  # of the article itself; its headings belong to it
        if tag in APART or (attrs.get("role") or "").lower() in ROLE_APART:
            return part
        names = (attrs.get("class") or "").split()
        if tag not in TEXT_BLOCK:
            names += (attrs.get("id") or "").split()
        for words in map(_words_of, names):
            if words & NOT_APART or (tag == "article" and not in_article and not words & COMMENT_APART):
                continue
            if tag in HEADING or tag in ("td", "tr", "th"):
                words -= {"header", "footer"}
            if words & NAME_APART and words <= NAME_APART | NEUTRAL:
                return part
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            return
        if tag == "p" or tag == "li" or tag in HEADING:
            self._close_implied(tag)
        if tag == "body" or tag == "main" or tag == "article":
            self._leave_unclosed(tag)
        self._nodes += 1
        self._open = _Node(tag, self._open, None if self._open.unread else self._kind(tag, dict(attrs)), self._nodes)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # a slash does not close other elements
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCK:
            self._flush()
        at: _Node | None = self._open
        while at is not None and at.tag != tag:
            if tag not in BLOCK and at.tag in CONTAINER:
                return  # a stray end of an inline element closes no container
            at = at.parent
        if at is not None and at.parent is not None:
            self._open = at.parent

    def handle_data(self, data: str) -> None:
        if not self._open.unread:
            self._text.append(data)

    def _close_implied(self, tag: str) -> None:
        """A new paragraph, item or heading ends an open one of its kind."""
        same = ("p",) if tag != "li" else ("li",)
        at: _Node | None = self._open
        while at is not None and at.tag not in CONTAINER and at.tag not in ("ul", "ol", "header"):
            if at.tag in same and at.parent is not None:
                self._open = at.parent
                return
            at = at.parent

    def _leave_unclosed(self, tag: str) -> None:
        """The article is not inside a menu whose end tag was forgotten."""
        at: _Node | None = self._open
        while at is not None:
            leave = ("head", "nav", "header", "form", "menu") if tag == "article" else APART
            if at.tag in leave and at.apart and at.parent is not None and not at.parent.apart:
                self._open = at.parent
                return
            at = at.parent

    def finish(self) -> list[_Line]:
        self.close()
        self._flush()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, renormalised at both ends."""
    radius = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    part = slice(radius, radius + len(ratios))
    return np.convolve(ratios, kernel)[part] / np.convolve(np.ones(len(ratios)), kernel)[part]


def threshold(values: np.ndarray) -> float:
    """Border of two clusters: midway between the means it makes, iterated."""
    at = float(values.mean())
    for _ in range(50):
        low, high = values[values <= at], values[values > at]
        if not len(low) or not len(high):
            break
        new = float(low.mean() + high.mean()) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at


def contents(lines: list[_Line]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are in the cluster of high smoothed ratios, and which have such a ratio themselves.

    All lines are both if there are no two clusters. Clusters are of magnitudes: paragraphs of
    100 and of 300 characters are both text beside links of 5.
    """
    own = np.array([len(x.text) / x.tags for x in lines], float)
    ratio = np.log1p(smoothed(own))
    border = threshold(ratio)
    content, high = ratio > border, np.log1p(own) > border
    if not content.any() or content.all() or ratio[content].mean() - ratio[~content].mean() < APART_BY:
        content[:] = high[:] = True
    return content, high


def region(lines: list[_Line]) -> list[_Line]:
    """The lines of the article, in page order."""
    if not lines:
        return []
    content, high = contents(lines)
    usable = _outside_parts(lines, content)
    if not usable.any():
        return []
    chosen = content & usable
    if not chosen.any():
        chosen = usable
    for line, inside in zip(lines, chosen):
        if inside:
            line.node.mass += len(line.text)
    nodes = _upwards(lines)
    for node in nodes:  # an inner element comes before the one around it
        if node.parent is not None:
            node.parent.mass += node.mass
    total = nodes[-1].mass
    roots = _articles(nodes, total)
    if not roots:
        roots = [_with_heading(max((x for x in nodes if x.mass >= SHARE * total), key=lambda x: x.depth), lines)]
    chosen_roots = {x.number for x in roots}
    for node in reversed(nodes):
        node.inside = node.number in chosen_roots or (node.parent is not None and bool(node.parent.inside))
    inside = np.array([bool(x.node.inside) for x in lines])
    least = max(LONG_TEXT, LIKE * sum(len(x.text) for x, c, i in zip(lines, chosen, inside) if c and i))
    outside = chosen & ~inside
    for run in np.split(np.arange(len(lines)), np.flatnonzero(outside[1:] != outside[:-1]) + 1):
        own = run[high[run]]
        if outside[run[0]] and sum(len(lines[k].text) for k in own) >= least:  # a long cluster of its own
            inside[own[0] : own[-1] + 1] = True
    return [x for x, i, u in zip(lines, inside, usable) if i and u]


def _outside_parts(lines: list[_Line], content: np.ndarray) -> np.ndarray:
    """Lines in no part of the page, but for parts that outvote all that is in none."""
    taken: set[int] = set()
    while True:
        free = 0
        mass: dict[int, int] = {}
        within = [next((p.number for p in x.parts if p.number not in taken), None) for x in lines]
        for line, part, c in zip(lines, within, content):
            if c and part is None:
                free += len(line.text)
            elif c:
                mass[part] = mass.get(part, 0) + len(line.text)
        more = {p for p, n in mass.items() if n >= LONG_TEXT and n > OUTVOTES * free}
        if not more:
            return np.array([p is None for p in within])
        taken.add(max(more, key=lambda p: (mass[p], -p)))


def _articles(nodes: list[_Node], total: int) -> list[_Node]:
    """``article`` elements, or a ``main`` one, that have a fair share of the content each and most of it together."""
    for tag in ("article", "main"):
        outer, within = [], set()
        for node in reversed(nodes):  # from outside in
            if node.parent is not None and node.parent.number in within:
                within.add(node.number)
            elif node.tag == tag and node.mass:
                within.add(node.number)
                outer.append(node)
        largest = max((x.mass for x in outer), default=0)
        found = [x for x in outer if x.mass >= LIKE * largest]
        if found and sum(x.mass for x in found) >= MOST * total:
            return found
    return []


def _upwards(lines: list[_Line]) -> list[_Node]:
    """All elements around the lines, the latest opened first, the root last."""
    seen: dict[int, _Node] = {}
    for line in lines:
        at: _Node | None = line.node
        while at is not None and at.number not in seen:
            seen[at.number] = at
            at = at.parent
    return [seen[i] for i in sorted(seen, reverse=True)]


def _with_heading(root: _Node, lines: list[_Line]) -> _Node:
    """Widen to the container of the page's first heading, short of the body."""
    head = next((x.node for x in lines if x.heading), None)
    around = set()
    while head is not None:
        around.add(head.number)
        head = head.parent
    at: _Node | None = root
    while around and at is not None and at.tag not in ("body", "html", "#"):
        if at.number in around:
            return at
        at = at.parent
    return root


def main_text(html: str | None) -> str:
    """The article of a page, one line for each block.

    The empty text for a NULL or empty page and for one without text outside
    its menus, forms and the like.
    """
    if not html:
        return ""
    parser = PageLines()
    for i in range(0, len(html), PIECE):
        parser.feed(html[i : i + PIECE])
    return "\n".join(x.text for x in region(parser.finish()))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars``, one row per page.

    Pages are parsed whole. NULL pages have an empty text, NULL keys stay NULL,
    repeated pages are kept as often as they come, an empty table gives no
    rows; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))],
            [*batch.schema.names[:-1], "text", "n_chars"],
        )

    slim = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return map_arrow(slim, run, f"{fields}, text string, n_chars long")
