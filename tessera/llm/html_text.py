"""Main text of HTML pages by composite text density of their blocks."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed names of HTML. Blocks; blocks that hold blocks; elements without content; elements whose content is skipped to their end tag, the first four even where there is none.
BLOCKS = frozenset("html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("html body article div section main center header ul ol dl dir table tbody thead tfoot tr details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TO_THE_END = frozenset("script style textarea title".split())
SKIPPED = TO_THE_END | frozenset("noscript template iframe svg object select noembed noframes canvas audio video button label datalist".split())
#: What a start tag closes, and where the search for it ends.
CLOSES = {name: (frozenset(closed.split()), frozenset(ends.split())) for names, closed, ends in (("li", "li", "ul ol menu dir"), ("dt dd", "dt dd", "dl"), ("td th", "td th", "tr table"), ("tr", "tr", "table"), ("tbody tfoot thead", "tbody tfoot thead", "table")) for name in names.split()}
CELLS = frozenset("td th caption".split())

#: What is no part of an article: elements, roles, and words of a class or id.
APART = frozenset("head nav footer aside form dialog menu search fieldset hr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = re.compile(
    r"ads?|adv|adverts?|advertise\w*|ad(?:box|slot|sense|unit|sbygoogle|banner|bar)|sponsor\w*|promo\w*|banners?|nav|nav(?:bar|igation|links?|list|menu)|\w+nav|menus?|\w+menu|breadcrumbs?|headers?|(?:site|page|top|global)header|masthead|topbar"
    r"|\w*footer|\w*sidebar|sidebox|aside|\w*comments?|comment(?:s?list|area|box|block|section|form|er|body|text|thread)|respond|repl(?:y|ies)|disqus|discussion|\w*cookies?|cookie(?:bar|notice|banner|consent|law)|consent|gdpr|notices?|notification|popup|modal|overlay"
    r"|newsletter|subscri\w+|signup|login|shar(?:e|ing)|sharebar|social|related|recommend\w*|pagination|pager|toolbar|widgets?|copyright|alert|paywall|search|searchbox|searchform"
)
#: Names that only say how a part is laid out.
LAYOUT = re.compile(r"(?:has|with|no|without|not|is)[-_]\w[\w-]*", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)

#: Blocks nested deeper belong to their ancestor at this depth.
DEEPEST = 256
#: Least logarithm's base of the density, for pages without links.
LEAST_BASE = 1.1
#: Share of links from which a list of at least ``MENU`` links is a menu.
LINKED, MENU = 0.8, 3


@dataclass(eq=False)
class Node:
    """A block, or a run of text between blocks (no name). Counts are of the whole subtree, without what is apart."""

    name: str
    up: Node | None = None
    depth: int = 0
    apart: bool = False
    article: bool = False
    parts: list[Node] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    chars: int = 0
    tags: int = 1
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0

    def nearest(self, names: frozenset[str] | set[str]) -> Node | None:
        node = self
        while node is not None and node.name not in names:
            node = node.up
        return node


def is_apart(name: str, attributes: str, article: bool) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or comment of readers, or hidden. In an article a header is the article's own."""
    if name in APART or name == "header" and not article:
        return True
    if name in ("html", "body", "main") or not attributes.strip() and "-" not in name:
        return False
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")) or found.get("role", "").lower() in ROLES:
        return True
    given = [x for c in ("class", "id") for x in found.get(c, "").split() if not LAYOUT.fullmatch(x)]
    words = {w for x in [*given, name if "-" in name else ""] for w in re.split(r"[^a-z0-9]+", CAMEL.sub("-", x).lower())}
    return any(NAMES.fullmatch(w) for w in words - ({"header", "headers", "banner"} if article else set()))


class Builder:
    """Builds the tree of a page's blocks from its tags and texts."""

    def __init__(self) -> None:
        self.root = self.node = Node("html")
        self.run: Node | None = None
        self.link: Node | None = None
        self.muted: tuple[str, int, int] | None = None
        self.beyond: dict[str, int] = {}

    def leave(self, node: Node) -> None:
        """Closes blocks until ``node`` is the open one, with links and hidden inline parts that began in them."""
        self.node, self.run = node, None
        if self.link is not None and self.link.depth > node.depth:
            self.link = None
        if self.muted and self.muted[2] > node.depth:
            self.muted = None

    def add(self, piece: str) -> None:
        piece = html.unescape(piece) if "&" in piece else piece
        if self.muted or self.run is None and piece.isspace():
            return
        if self.run is None:
            self.run = Node("", self.node, self.node.depth + 1, self.node.apart, tags=0)
            self.node.parts.append(self.run)
        n = sum(map(len, piece.split()))
        self.run.text.append(piece)
        self.run.chars += n
        self.run.link_chars += n if self.link is not None else 0

    def end(self, name: str) -> None:
        if self.muted and self.muted[0] == name:
            self.muted = (name, self.muted[1] - 1, self.muted[2]) if self.muted[1] > 1 else None
        elif name == "a":
            self.link = None
        elif self.beyond.get(name):
            self.beyond[name] -= 1
            self.run = None
        elif name in BLOCKS and name not in ("html", "body"):
            found = self.node.nearest({name} if name == "table" or name in CLOSES and name != "li" else {name} | CELLS)
            if found is not None and found.name == name:
                self.leave(found.up)

    def start(self, name: str, attributes: str, ends: bool) -> None:
        """``ends``: whether an end tag of an inline element follows anywhere."""
        if name not in BLOCKS:
            if self.muted:
                self.muted = (name, self.muted[1] + 1, self.muted[2]) if self.muted[0] == name else self.muted
            elif ends and is_apart(name, attributes, self.node.article):
                self.muted = (name, 1, self.node.depth)
            else:
                own = self.run or self.node
                own.tags += 1
                own.link_tags += name == "a"
                if name == "a":
                    self.link = self.node
                elif name == "br":
                    self.add(" ")
            return
        if name == "html" or name == "body" and self.node.nearest({"body"}):
            return
        if self.node.name == "p" or self.node.name in HEADINGS and name in HEADINGS:
            self.leave(self.node.up)
        if name == "body":
            self.leave(self.root)
        if name in CLOSES:
            closed, stops = CLOSES[name]
            found = self.node.nearest(closed | stops)
            if found is not None and found.name in closed:
                self.leave(found.up)
        self.run = None
        if self.node.depth >= DEEPEST:
            self.beyond[name] = self.beyond.get(name, 0) + 1
            self.node.tags += 1
            return
        up = self.node
        node = Node(name, up, up.depth + 1, up.apart or self.muted is not None or is_apart(name, attributes, up.article), up.article or name == "article")
        up.parts.append(node)
        self.node = up if name == "hr" else node


def blocks(page: str) -> Node:
    """The blocks of a page as a tree. Unclosed blocks end where the next one says so, end tags without a start are left out."""
    made, at, lower = Builder(), 0, ""
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0] == "<" or m[0][0] != "<":
                made.add(m[0])
        elif m[1] or m[4]:
            made.end(name)
        else:
            attributes = m[3] or m[6] or ""
            lower = lower or page.lower()
            skip = name in SKIPPED
            close = lower.find(f"</{name}", at) if skip or name not in BLOCKS and attributes.strip() else -1
            if not skip:
                made.start(name, attributes, close >= 0)
            elif close >= 0 or name in TO_THE_END:
                at = len(page) if close < 0 else close
    return made.root


def measure(root: Node) -> list[Node]:
    """All nodes in page order, with densities (characters a tag, the less the more of them are links) and their sums over parts."""
    order, stack = [], [root]
    while stack:
        order.append(node := stack.pop())
        stack.extend(reversed(node.parts))
    for node in reversed(order):
        for p in node.parts:
            if not p.apart:
                node.chars, node.tags, node.link_chars, node.link_tags = node.chars + p.chars, node.tags + p.tags, node.link_chars + p.link_chars, node.link_tags + p.link_tags
    body = next((n for n in order if n.name == "body"), root)
    linked = body.link_chars / max(1, body.chars)
    for node in order:
        c, t = node.chars, max(1, node.tags)
        base = math.log(c / max(1, c - node.link_chars) * node.link_chars + linked * c + math.e)
        worth = c / max(1, node.link_chars) * t / max(1, node.link_tags)
        node.density = c / t * math.log(worth) / math.log(max(LEAST_BASE, base)) if worth > 1 else 0.0
    for node in order:
        held = [p for p in node.parts if not p.apart]
        node.total = sum(p.density for p in held) if any(p.name for p in held) else node.density
    return order


def menu(node: Node) -> bool:
    return node.name in HOLDERS and node.link_tags >= MENU and node.link_chars >= LINKED * node.chars


def kept(order: list[Node]) -> Iterator[Node]:
    """The roots of what is selected, in page order.

    The block whose parts' densities have the greatest sum (of equals the outermost) is selected, or
    the article or main element around it. Beside the way from it up to the body are selected the blocks
    whose density, and plain characters a tag, are at least the least ones on that way, and headings before it.
    """
    best = max((n for n in order if n.name and not n.apart), key=lambda n: n.total)
    root = best.nearest({"article"}) or best.nearest({"main"}) or best
    way = [root]
    while way[-1].up is not None and way[-1].name != "body":
        way.append(way[-1].up)
    least, plain = min(n.density for n in way), min(n.chars / max(1, n.tags) for n in way)
    on_way = set(way)

    def dense(p: Node) -> bool:
        return p.chars > 0 and p.density >= least and p.chars / max(1, p.tags) >= plain

    if root.name in ("body", "html"):
        yield from (p for p in root.parts if p.name not in HOLDERS or dense(p) or p.name == "body")
        return

    def beside(node: Node) -> Iterator[Node]:
        before = True
        for p in node.parts:
            if p is root:
                yield p
            elif p in on_way:
                yield from beside(p)
            elif dense(p) or before and p.name in HEADINGS and 2 * p.link_chars < p.chars:
                yield p
            before = before and p not in on_way

    yield from beside(way[-1])


def main_text(page: str | None) -> str:
    """The article of a page, a line a block; empty for null, an empty page or one without text."""
    if not page:
        return ""
    lines, stack = [], list(kept(measure(blocks(page))))[::-1]
    while stack:
        node = stack.pop()
        if node.apart or menu(node):
            continue
        if not node.name:
            lines.append(" ".join("".join(node.text).split()))
        stack.extend(reversed(node.parts))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Whole pages are read, one at a time in a task, whatever their length; tags nested deeper than
    256 blocks count for the 256th. Scripts, styles, comments, menus, headers, footers,
    sidebars, notices, adverts, forms and readers' comments go. Character references are decoded,
    white space within a block (line breaks included) becomes one space, and blocks are joined by a line
    feed. Broken markup ends where the next tag says so.

    Returns page_id, url, text (empty where there is none, and for a null page), n_chars (code
    points). Rows without page_id or url and repeated rows each get their text. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
