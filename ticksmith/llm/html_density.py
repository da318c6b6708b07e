"""Main text of HTML pages by composite text density.

Each page becomes a tree of elements. A node's composite density is its characters per tag, adjusted by links::

    C/T * log_b( C*T / (LC*LT) ),  b = ln( C/(C-LC) * LC + LC_body/C_body * C + e )

with C, T the characters and tags below it and LC, LT those of links. The density sum of a node adds its children's
densities, but for marked ones. The node of the largest sum is chosen; the threshold is the smallest density on its path
to the body. Nodes that reach the threshold are content, each by its subtree of largest sum, and the article is the
lowest node on the path above all content. It grows to the ``article`` or ``main`` around it if what that adds isn't
mostly links, and one that holds most of the page's text bounds what counts as content: dense text beside it, such as
readers' comments, is others'. Headings that stand before it on the path stay.

Scripts, styles, forms and hidden elements are cut off before densities are taken. Names come in two kinds. Elements,
roles and words of class and id that always name menus, headers, footers, sidebars, notices, adverts or comments mark a
node: it isn't chosen as long as another has a tenth of its density sum, isn't content elsewhere, and is left out of the
article. Words that articles use of their own parts as well (share, related, social) only make a node doubtful: it is left
out if its density is under a twentieth of the threshold or half of its text is links.

Blocks are block elements' texts: references decoded, white space made one space, trimmed, joined by blank lines.

Defined results: null html is empty; a page without text gives an empty string; repeated page_ids each give a row;
an empty table gives no rows; other columns are ignored. Nothing is dropped inside the article for being short. Every
page is worked on where it is read; nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names from the HTML standard, and usual words of class and id attributes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
DROP = {"script", "style", "noscript", "template", "head", "title", "form", "button", "select", "option", "textarea", "input", "label", "iframe", "embed", "svg", "canvas", "dialog", "audio", "video", "search", "noembed", "noframes"}
MARK = {"nav", "menu", "footer", "aside"}
MARK_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
MARK_WORD = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "menubar", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "sidebar", "sidebars", "sponsor", "sponsored"}
#: Words that articles use of their own parts too: density decides.
MAYBE_WORD = {"banner", "modal", "popup", "promo", "promoted", "related", "recommended", "replies", "reply", "respond", "share", "sharing", "signup", "skip", "social", "subscribe", "toolbar", "topbar", "widget", "widgets"}
#: Elements whose start ends an open one of the listed names.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr"}, {"table"})}
#: An end tag never reaches over these.
SCOPE = {"table", "td", "th", "article", "main", "body", "html", "div", "section", "nav", "aside", "footer", "header", "form", "ul", "ol", "dl"}

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[a-zA-Z][^>]*(?:>|\Z)", re.S)
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: What follows a start tag's name; a quote that is never closed is an ordinary character.
_TAG_REST = re.compile(r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*>")
_ATTR = re.compile(r"([^\s/=\"'>][^\s/=>]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?", re.S)
_USED = {"class", "id", "role", "hidden", "aria-hidden", "style"}
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


#: A marked node is chosen only if no other one has this share of its density sum.
TIE = 1 / 10
#: A doubtful node stays from this share of the threshold on; short paragraphs reach it, lists of words don't.
DOUBT = 1 / 20
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    __slots__ = ("name", "parent", "block", "depth", "parts", "kids", "drop", "mark", "maybe", "chars", "tags", "link_chars", "link_tags", "density", "total", "sum")

    def __init__(self, name: str, parent: Node | None, drop: bool = False, mark: bool = False, maybe: bool = False):
        self.name, self.parent, self.drop, self.mark, self.maybe = name, parent, drop, mark, maybe
        self.depth = parent.depth + 1 if parent is not None else 0
        self.block = self if parent is None or name in BLOCK else parent.block  # the nearest block around the place
        self.parts: list[Node | str] = []  # children and texts in page order; references are decoded


def _attributes(raw: str) -> dict[str, str]:
    """Those in use, read one after another, so that no value is taken for a name; the first of a name counts."""
    given: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        if (name := m[1].lower()) in _USED:
            given.setdefault(name, m[2] or m[3] or m[4] or "")
    return given


def _judge(name: str, raw: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is cut off, whether its name says that it's no part of an article, and whether it may say so.

    ``inside``: an article or main stands around it.
    """
    if name in DROP:
        return True, True, False
    given = _attributes(raw) if raw else {}
    if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
        return True, True, False
    if name in MARK or name == "header" and not inside or given.get("role", "").lower() in MARK_ROLE:
        return False, True, False
    if not given or name in ("body", "html", "article", "main"):
        return False, False, False
    words = {w for key in ("class", "id") for w in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", given.get(key, "")).lower())}
    found = words & MARK_WORD
    # "content-with-sidebar" names a layout around the article, not the sidebar
    if not found:
        return False, False, bool(words & MAYBE_WORD)
    mark = not words & {"article", "content", "main", "wrapper", "container", "layout", "page", "body", "text", "entry"} - ({"content"} if found & {"ad", "ads", "advert", "advertisement", "sponsored"} else set())
    return False, mark, False


def _text(raw: str) -> str:
    return html.unescape(raw) if "&" in raw else raw


class _Open:
    """The open elements: depths by name, so that no tag needs a walk over them."""

    def __init__(self, root: Node):
        self.node = self.root = root
        self.depths: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def lowest(self, names) -> int:
        """Depth of the innermost open element of one of the names; 0 for none."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def push(self, node: Node) -> None:
        self.node = node
        self.depths.setdefault(node.name, []).append(node.depth)
        if node.name in SCOPE:
            self.scopes.append(node.depth)

    def close(self, depth: int) -> None:
        """Close all elements at ``depth`` and below."""
        while self.node.depth >= max(depth, 1):
            self.depths[self.node.name].pop()
            if self.node.name in SCOPE:
                self.scopes.pop()
            self.node = self.node.parent


def parse(page: str) -> Node:
    """The page's tree; tags that aren't closed end with their block, as browsers end them. Time is linear in the page."""
    root = Node("html", None)
    open_ = _Open(root)
    at, size, quotes = 0, len(page), True
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            open_.node.parts.append(_text(page[at:]))
            break
        if lt > at:
            open_.node.parts.append(_text(page[at:lt]))
        start = _TAG_NAME.match(page, lt)
        if start is None or page[lt + 1] == "/":
            m = _OTHER.match(page, lt)
            at = m.end() if m else lt + 1
            if m is None:
                open_.node.parts.append("<")
            elif start is not None:
                name = start[1].lower()
                depth = open_.lowest((name,))
                if depth and (name in SCOPE or not open_.scopes or open_.scopes[-1] < depth):
                    open_.close(depth)
                elif name == "br":
                    open_.node.parts.append(" ")
            continue
        m = _TAG_REST.match(page, start.end()) if quotes else None
        if m is None:  # quotes don't close up to the page's end; from here on they don't count
            quotes = False
            end = page.find(">", start.end())
            raw, at = page[start.end() : end if end >= 0 else size], end + 1 if end >= 0 else size
        else:
            raw, at = m[0][:-1], m.end()
        name = start[1].lower()
        if name in ("html", "body"):
            if name == "body":
                open_.close(1)
            continue
        if name in BLOCK:  # a block ends an open paragraph or heading around it, with the inline elements left open in it
            up = open_.node.block
            if up is not root and (up.name == "p" or up.name in HEADINGS):
                open_.close(up.depth)
        if name in CLOSES:
            names, limit = CLOSES[name]
            if (depth := open_.lowest(names)) > open_.lowest(limit - names):
                # of several open ones within the limit, the innermost is closed
                open_.close(depth)
        new = Node(name, open_.node, *_judge(name, raw, bool(open_.lowest(("article", "main")))))
        open_.node.parts.append(new)
        if name in VOID or raw.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        open_.push(new)
    return root


def _order(root: Node) -> list[Node]:
    """Nodes that aren't cut off, parents first; each gets its list of such children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        node.kids = kids = [x for x in node.parts if x.__class__ is Node and not x.drop]
        if kids:
            stack += kids[::-1]
    return out


def density(c: int, t: int, lc: int, lt: int, part: float) -> float:
    """Composite density of a node; ``part``: the body's share of characters in links."""
    if not c:
        return 0.0
    t, lt = max(1, t), max(1, lt)
    base = math.log(c / max(1, c - lc) * lc + part * c + math.e)
    # at least 2, as nodes of few tags would otherwise divide by the logarithm of nearly 1
    return c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(max(base, 2.0))


def measure(root: Node) -> list[Node]:
    """Take characters, tags, densities and sums of all nodes; returns them parents first."""
    nodes = _order(root)
    for node in reversed(nodes):
        chars = link_chars = link_tags = 0
        tags = len(node.kids)
        for x in node.parts:
            if x.__class__ is str:
                chars += len(_SPACE.sub(" ", x).strip())
        for x in node.kids:
            chars += x.chars
            tags += x.tags
            link_chars += x.link_chars
            link_tags += x.link_tags
        node.chars, node.tags = chars, tags
        node.link_chars, node.link_tags = (chars, tags + 1) if node.name == "a" else (link_chars, link_tags)
    part = root.link_chars / root.chars if root.chars else 0.0
    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, part)
    for node in nodes:
        total = free = 0.0
        for x in node.kids:
            total += x.density
            if not x.mark:
                free += x.density
        node.total, node.sum = total, free
    return nodes


def choose(nodes: list[Node]) -> tuple[Node, float]:
    """The node of the largest density sum, marked ones only beyond a tie, and the threshold on its path to the body."""
    marked: dict[Node, bool] = {}
    for node in nodes:
        marked[node] = node.mark or node.parent is not None and marked[node.parent]
    whole = [n for n in nodes if n is n.block]
    best = max(whole, key=lambda n: n.sum)
    free = max((n for n in whole if not marked[n]), key=lambda n: n.sum)
    if free.sum >= TIE * best.sum:
        best = free
    threshold, up = best.density, best
    while up.parent is not None:
        up = up.parent
        threshold = min(threshold, up.density)
    return best, threshold


def _free(root: Node) -> list[Node]:
    """Topmost nodes that aren't marked, of which the children of those that hold marked ones."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.mark:
            continue
        if node.density and any(x.mark for x in node.kids):
            stack += node.kids
        else:
            out.append(node)
    return out


def article(root: Node) -> Node:
    """The node whose text, without what is marked or cut off, is the page's article."""
    nodes = measure(root)
    best, threshold = choose(nodes)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    for node in path:
        node.mark = False
    for node in nodes:
        if node.maybe and node not in path and (2 * node.link_chars >= node.chars or node.density < DOUBT * threshold):
            node.mark = True
    # the largest sum and its place within each subtree, children first
    top: dict[Node, Node] = {}
    end: dict[Node, int] = {}  # places of a subtree are one range of page order
    place = {node: k for k, node in enumerate(nodes)}
    for node in reversed(nodes):
        most = node
        for x in node.kids:
            if not x.mark and top[x].sum > most.sum:
                most = top[x]
        top[node] = most
        end[node] = end[node.kids[-1]] if node.kids else place[node] + 1
    first = last = place[best]
    # an article or main that holds most of the text is all of it: what is dense beside it is others' text
    around = next((n for n in path if n.name in ("article", "main")), root)
    around = around if 2 * around.chars >= sum(n.chars for n in _free(root)) else root
    stack = [around]
    while stack:
        node = stack.pop()
        if node.density >= threshold and node.chars and 2 * node.link_chars <= node.chars:
            at = place[top[node] if node.sum else node]
            first, last = min(first, at), max(last, at)
        stack += [x for x in node.kids if not x.mark]
    # the lowest node on the path that is above all content
    k = next(k for k, n in enumerate(path) if place[n] <= first and last < end[n])
    part = root.link_chars / root.chars if root.chars else 0.0
    for j in range(k + 1, len(path)):  # text that stands in the path's nodes themselves
        if any(density(len(x.strip()), 1, 0, 1, part) >= threshold for x in path[j].parts if isinstance(x, str) and not x.isspace()):
            k = j
    # up to the article or main around it, unless that adds mostly links
    j = next((j for j in range(k, len(path)) if path[j].name in ("article", "main")), k)
    if 2 * (path[j].link_chars - path[k].link_chars) < path[j].chars - path[k].chars:
        k = j
    # up to the body, only headings before the article stay
    for node, up in zip(path[k:], path[k + 1 :]):
        own = next(j for j, x in enumerate(up.parts) if x is node)
        up.parts = [x for x in up.parts[:own] if isinstance(x, Node) and x.name in HEADINGS] + [node]
    return root


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node`` in page order."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            end()
        elif x.drop or x.mark:
            if x.name in BLOCK:
                end()
        elif x.name in ("br", "wbr"):
            run.append(" " if x.name == "br" else "")
        elif x.name in BLOCK:
            end()
            stack.append(None)
            stack.extend(reversed(x.parts))
        else:
            stack.extend(reversed(x.parts))
    end()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(article(parse(page)))) if page else ""


_DDL = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, _DDL)
