"""Main text of web pages by composite text density.

Each page becomes a tree of elements. Every element has characters, tags (marks inside a block count as its
text), and those of them inside links; its density is characters per tag, adjusted by its link share against
the body's. The element with the largest sum of its children's densities is the main subtree. The threshold
is the least density on its way up, below the body: parts elsewhere that reach it are text too. A page says with
its h1 what it is about: if an element around that, below the body, has a fair part of the largest sum or of its text, the innermost such is
the main subtree, and other parts count only in the body's child that holds it, so that denser matter beside the text, such
as what readers wrote, does not take its place. An h1 that stands alone before the text belongs to it. What a page
itself marks is only asked where density allows it: an article or main element around the main subtree is
taken whole if it is as dense as the body, and an element whose class or id has no words but those of adverts,
menus and the like is left out unless it holds half of the page's text and no article is beside it. Elements that HTML has for menus,
footers, asides, forms, scripts and styles are never text. Work is linear in the page, however deep.

Defined cases: null or empty html gives an empty text; a page cut off inside a tag, comment, script or
quoted attribute loses only that piece; of ties in the sum the outer element, then the first, is taken; very
long and very deep pages are read whole; repeated rows are extracted each; a null page_id or url stays null;
other columns, whatever their names, are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|[\"'].*\Z|\Z)|<\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_DROPPED = {"nav", "footer", "aside", "form", "button", "select", "svg", "template", "dialog", "menu", "head", "object", "canvas", "audio", "video", "map", "datalist", *_RAW}
#: Words of classes and ids that name what is no text, and words that stand beside them.
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus",
    "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo", "related",
    "replies", "reply", "respond", "responses", "discussion", "discussions", "opinions", "reactions", "talkback", "guestbook", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
_BESIDE = {
    "site", "page", "main", "top", "bottom", "left", "right", "list", "links", "bar", "box", "buttons", "posts", "articles", "stories", "wrapper", "wrap", "container", "inner", "outer",
    "signup", "section", "area", "block", "slot", "unit", "global", "primary", "secondary", "header", "item", "items", "thread", "form", "message", "icons", "media", "text", "user", "reader",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: An open element of the key is closed by the start of one of these.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_P_ENDS = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SPACE = re.compile(r"\s+")
#: Share of the largest density sum, or of that subtree's characters, that an element around the h1 has to have.
HEADED = 0.25


TEXT, SUSPECT, NOISE = range(3)
_LIST_ENDS = ("ul", "ol", "dl", "table", "select", "div", "article", "section")
_SCOPES = ("article", "main", "table", "td")
_ACROSS = {"article", "main", "table", "td", "tr", "tbody", "div", "section"}


class _Node:
    __slots__ = ("tag", "parent", "content", "kind", "inside", "chars", "tags", "link_chars", "link_tags", "articles", "density", "sum")

    def __init__(self, tag: str, parent: _Node | None, kind: int = TEXT):
        self.tag, self.parent, self.content, self.kind = tag, parent, [], kind
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.chars = self.tags = self.link_chars = self.link_tags = self.articles = 0
        self.density = self.sum = 0.0


def _named(value: str) -> bool:
    """Whether a name of a class or an id has no words but those of what is no text."""
    for name in value.split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words & _NAMES and words <= _NAMES | _BESIDE:
            return True
    return False


def _kind(tag: str, attributes: str, inside_article: bool) -> int:
    if tag in _DROPPED or tag == "header" and not inside_article:
        return NOISE
    kind = TEXT
    if not attributes or tag in ("html", "body", "main", "article"):
        return kind
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value in _ROLES or name == "aria-hidden" and value == "true":
            return NOISE
        if name in ("class", "id") and _named(value):
            kind = SUSPECT
    return NOISE if re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes) else kind


class _Open:
    """The open elements, and where the last one of each tag is among them."""

    def __init__(self, root: _Node):
        self.nodes, self.places = [root], {}

    def last(self, *tags: str) -> int:
        """0 (the body) if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def push(self, node: _Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """The element at a place and all in it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()


def _tree(page: str) -> _Node:
    root = _Node("body", None)
    open_ = _Open(root)
    block_ends = [0]  # places of open blocks
    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            open_.nodes[-1].content.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        tag, attributes = (found[2] or "").lower(), found[3] or ""
        if not tag or tag in ("html", "body"):
            continue
        if found[1]:
            place = open_.last(tag)
            if place and (tag in _ACROSS or place > open_.last(*_SCOPES)):
                open_.close(place)
            elif tag == "p":
                open_.nodes[-1].content.append(_Node("p", open_.nodes[-1]))
        elif tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            void = tag in _VOID or attributes.rstrip().endswith("/") and tag not in _BLOCK
            while block_ends[-1] >= len(open_.nodes):
                block_ends.pop()
            if tag in _P_ENDS and open_.nodes[block_ends[-1]].tag == "p":
                open_.close(block_ends[-1])
            if tag in _CLOSES and (place := open_.last(*_CLOSES[tag])) and place > open_.last(*_LIST_ENDS):
                open_.close(place)
            up = open_.nodes[-1]
            new = _Node(tag, up, _kind(tag, attributes, up.inside))
            up.content.append(new)
            if not void:
                open_.push(new)
                if tag in _BLOCK:
                    while block_ends[-1] >= len(open_.nodes) - 1:
                        block_ends.pop()
                    block_ends.append(len(open_.nodes) - 1)
    return root


def _letters(text: str) -> int:
    return len(_SPACE.sub(" ", text).strip())


def _below(root: _Node) -> list[_Node]:
    """root and all elements in it that may be text, parents before children, in page order."""
    nodes, todo = [], [root]
    while todo:
        x = todo.pop()
        nodes.append(x)
        todo += [c for c in reversed(x.content) if isinstance(c, _Node) and c.kind != NOISE]
    return nodes


def _count(nodes: list[_Node]) -> None:
    for x in reversed(nodes):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        x.articles = int(x.tag in ("article", "main"))
        for c in x.content:
            if isinstance(c, str):
                x.chars += _letters(c)
            elif c.kind != NOISE:
                x.articles += c.articles
                x.chars, x.tags, x.link_chars, x.link_tags = x.chars + c.chars, x.tags + c.tags + (c.tag in _BLOCK or c.tag == "a"), x.link_chars + c.link_chars, x.link_tags + c.link_tags
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    if not chars:
        return 0.0
    # Shares, a hundredth at least, so that without links the size of an element does not count.
    ratio = 1 / (max(link_chars / chars, 0.01) * max(min(link_tags / max(tags, 1), 1.0), 0.01))
    tags = max(tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_share * chars + math.e)
    return chars / tags * math.log(ratio + math.e - 1) / max(math.log(base), 1.0)


def _measure(root: _Node) -> list[_Node]:
    """Counts, densities and sums of all that may be text; suspects that hold less than half of it, or stand beside an article, are left out."""
    nodes = _below(root)
    _count(nodes)
    suspects = [x for x in nodes if x.kind == SUSPECT]
    for x in suspects:
        x.kind = TEXT if 2 * x.chars > root.chars and x.articles == root.articles else NOISE
    if suspects:
        nodes = _below(root)
        _count(nodes)
    share = root.link_chars / max(root.chars, 1)
    for x in nodes:
        x.density = _density(x.chars, x.tags, x.link_chars, x.link_tags, share)
    for x in reversed(nodes):
        # Marks inside a block are part of its text: they hand on what they hold.
        own = 0
        for c in x.content:
            if isinstance(c, str):
                own += _letters(c)
            elif c.kind != NOISE:
                x.sum += c.density if c.tag in _BLOCK else c.sum
        x.sum += _density(own, 1, own if x.tag == "a" else 0, int(x.tag == "a"), share)
    return nodes


def _chosen(nodes: list[_Node]) -> list[_Node]:
    """The main subtree, and the outermost other parts as dense as the least dense element on its way up, below the body."""
    root = nodes[0]
    best = root
    for x in nodes:
        if x.tag in _BLOCK and x.sum > best.sum:
            best = x
    head = next((x for x in nodes if x.tag == "h1" and x.chars and 2 * x.link_chars < x.chars), None)
    around, headed = head.parent if head else root, False
    while around is not root and not headed:
        if headed := around.tag in _BLOCK and around.chars >= 2 * head.chars and (around.sum >= HEADED * best.sum or around.chars - around.link_chars >= HEADED * best.chars):
            best = around
        around = around.parent
    if best is root:  # text straight in the body: lists of links beside it are less dense than the body
        for x in nodes[1:]:
            if x.tag in _BLOCK and x.density < root.density and 2 * x.link_chars > x.chars:
                x.kind = NOISE
        return [root]
    path, x = [], best
    while x is not root:
        path.append(x)
        x = x.parent
    top = path[-1]
    for x in path:  # the outermost article around it that is as dense as the body
        if x.tag in ("article", "main") and x.density >= root.density:
            best = x
    path = path[path.index(best) :]
    least = min(x.density for x in path)
    above = set(map(id, path))
    picked, todo = [], [top if headed else root]
    while todo:
        x = todo.pop()
        if x is best or id(x) not in above and x is not root and x.tag in _BLOCK and x.density >= least and 2 * x.link_chars < x.chars:
            picked.append(x)
        else:
            todo += [c for c in reversed(x.content) if isinstance(c, _Node) and c.kind != NOISE and c.chars]
    if head and not headed:  # alone before the text, unless that holds it
        order = {id(x): n for n, x in enumerate(nodes)}
        up = head
        while up is not None and not any(up is x for x in picked):
            up = up.parent
        if up is None and order[id(head)] < order[id(picked[0])]:
            picked.insert(0, head)
    return picked


def _blocks(node: _Node) -> list[str]:
    out, run = [], []

    def flush() -> None:
        if text := _SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.kind == NOISE:
            continue
        elif x.tag in _BLOCK:
            flush()
            todo.append(None)
            todo += reversed(x.content)
        elif x.tag == "br":
            run.append(" ")
        else:
            todo += reversed(x.content)
    flush()
    return out


def extract(page: str) -> str:
    nodes = _measure(_tree(page))
    return "\n".join(b for x in _chosen(nodes) for b in _blocks(x)) if nodes[0].chars else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x) if x else "" for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text and its code points, for every page; no shuffle."""
    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    return pages.select(*columns).mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
