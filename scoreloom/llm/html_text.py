"""Main text of web pages by tree scoring.

Markup becomes a tree of blocks.  Every paragraph gives points for its length and its commas to its parent, half
to its grandparent and a third, fourth, ... further up; a container's points are discounted by the share of its
text that is inside links.  The container with most points wins; its siblings come along if they score like
it, share its class or are paragraphs.  Parts that no article holds (menus, scripts, hidden parts, ...) are cut off before.  A form or an
element that is only named like such a part is cut off as well unless the page's points say that it holds the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Element names of HTML by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
DROPPED = set(
    "aside button canvas dialog footer head iframe input label menu nav noembed noframes noscript object option script "
    "select style svg template textarea title video audio".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KEPT = {"html", "body", "article", "main"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
# Names of parts that are often long prose, of parts of a layout, and of parts that can be prose of the article as well.
FOREIGN = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr comment comments "
    "commentlist commentarea commentform disqus replies respond newsletter subscribe signup login popup modal".split()
)
LAYOUT = set(
    "banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer share sharing social overlay pager pagination toolbar "
    "masthead skip".split()
)
LOOSE = set("notice alert related recommended promotion widget hidden".split())
OUTER_NAMES = {"header", "topbar"}

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
SPACE = re.compile(r"\s+")
#: A block gives points to containers so far up that at least this much arrives.
LEAST = 0.02
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("name", "attrs", "parent", "outer", "children", "score", "length", "linked")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        # the next element above that is a block, or the root
        self.outer = parent if parent is None or parent.name in BLOCK or parent.parent is None else parent.outer
        self.children: list[Node | str] = []
        self.score, self.length, self.linked = 0.0, 0, 0


def _attributes(text: str) -> dict[str, str]:
    if not text.strip(" /"):
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def parse(page: str) -> Node:
    """The tree of a page.  Unclosed elements end with their parent; a paragraph ends at the next block."""
    root = Node("html", {}, None)
    at, depth = root, Counter(("html",))  # depth: how many elements of a name are open

    def leave(until: Node) -> None:
        """Close everything from the innermost open element up to ``until``."""
        nonlocal at
        while at is not until:
            depth[at.name] -= 1
            at = at.parent

    place, size = 0, len(page)
    while place < size:
        m = TOKEN.search(page, place)
        if m is None:
            at.children.append(page[place:])
            break
        if m.start() > place:
            at.children.append(page[place : m.start()])
        place = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["close"] or m["close2"]:
            if depth[name] and name != "html":
                node = at
                while node.name != name:
                    node = node.parent
                leave(node.parent)
            continue
        if name in BLOCK and name != "html":
            node = at
            while node.parent is not None and node.name not in BLOCK:
                node = node.outer
            if node.name == "p" or name in HEADINGS and node.name in HEADINGS:
                leave(node.parent)
            elif name in CLOSES and any(depth[x] for x in CLOSES[name]):
                until = None
                while node.parent is not None and node.name not in WALLS[name]:
                    if node.name in CLOSES[name]:
                        until = node.parent
                    node = node.parent
                if until is not None:
                    leave(until)
        if name == "html" or name == "body" and any(isinstance(c, Node) and c.name == "body" for c in root.children):
            continue
        if name in ("body", "head"):
            leave(root)
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        node = Node(name, _attributes(attrs or ""), at)
        at.children.append(node)
        if name in VOID or (attrs or "").endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, place)
            place = size if end is None else end.start()
        at = node
        depth[name] += 1
    return root


def _unwanted(node: Node, inside: bool, homes: set[int]) -> str | None:
    """Why a part is no article text; ``inside``: it stands in an article or main element; ``homes``: the parts that hold one.

    ``always``, or by its name only: ``foreign``, ``layout`` or ``loose``; None for other parts.
    """
    if node.name in DROPPED:
        return "always"
    if node.name in KEPT:
        return None
    if node.name == "header" and not inside:
        return "always"
    a = node.attrs
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return "always"
    role = a.get("role", "").lower()
    if role in ROLES:
        return "always"
    names = {p.lower() for p in PART.findall(f"{a.get('class', '')} {a.get('id', '')}")} if a else set()
    if node.name == "form" or role == "form":
        why = "layout"
    elif names & FOREIGN:
        why = "foreign"
    elif names & LAYOUT or not inside and names & OUTER_NAMES:
        why = "layout"
    elif names & LOOSE:
        why = "loose"
    else:
        return None
    # a layout element may be named after a menu or sidebar that it also holds
    return why if inside or id(node) not in homes else None


def _article_homes(root: Node) -> set[int]:
    """All elements above an article or main element."""
    homes: set[int] = set()
    stack = [root]
    while stack:
        node = stack.pop()
        if node.name in ("article", "main"):
            up = node.parent
            while up is not None and id(up) not in homes:
                homes.add(id(up))
                up = up.parent
        stack += [c for c in node.children if isinstance(c, Node)]
    return homes


def _prune(node: Node) -> None:
    """Cut off what is always unwanted, then the merely named parts that do not hold the article."""
    root, named, homes = node, {}, _article_homes(node)
    stack = [(node, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.name in ("article", "main")
        children = []
        for c in node.children:
            why = None if isinstance(c, str) else _unwanted(c, inside, homes)
            if why != "always":
                children.append(c)
            if why and why != "always":
                named[id(c)] = why
        node.children = children
        stack += [(c, inside) for c in children if isinstance(c, Node)]
    if not named:
        return
    keep = _homes(root, named)
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or id(c) not in named or id(c) in keep]
        stack += [c for c in node.children if isinstance(c, Node)]


def _homes(root: Node, named: dict[int, str]) -> set[int]:
    """The named parts to keep, by the points of the text that stands in them and in no named part below.

    A layout or loose name does not count if its part holds most of the page's points without foreign parts; if next to nothing
    stands outside of layout parts, none of their names counts.  Foreign parts can be longer than the article, so one of
    them is kept only if next to nothing stands elsewhere.
    """
    own: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    around = _nearest(root, named)
    for node, text, linked in _blocks(root):
        up = around[id(node)]
        if up is not None:
            nodes[id(up)] = up
        at = 0 if up is None else id(up)
        own[at] = own.get(at, 0.0) + _points(node, text, linked)
    outside = own.pop(0, 0.0)
    loose = {k: x for k, x in own.items() if named[k] == "loose"}
    layout = {k: x for k, x in own.items() if named[k] == "layout"}
    foreign = {k: x for k, x in own.items() if named[k] == "foreign"}
    total = outside + sum(layout.values()) + sum(loose.values())
    home = [k for k, x in (layout | loose).items() if x > 0.5 * total] or [k for k in layout if outside < 0.1 * (total - sum(loose.values()))]
    rest = outside + sum(own[k] for k in home)
    if not home and loose and outside < 0.1 * total:  # all of the page is loose parts of one kind
        home = list(loose)
        rest = total
    if rest < 10 and rest < 0.1 * sum(foreign.values()):
        home += [k for k, x in foreign.items() if x >= 0.2 * sum(foreign.values())][:1]
    keep: set[int] = set()
    for k in home:
        up = nodes[k]
        while up is not None and id(up) not in keep:
            keep.add(id(up))
            up = up.parent
    return keep


def _nearest(root: Node, marked: dict[int, str] | set[int]) -> dict[int, Node | None]:
    """For every element the nearest marked one at or above it."""
    found: dict[int, Node | None] = {}
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        node, above = stack.pop()
        above = node if id(node) in marked else above
        found[id(node)] = above
        stack += [(c, above) for c in node.children if isinstance(c, Node)]
    return found


def _points(node: Node, text: str, linked: int) -> float:
    """Points of a block of text; headings give none."""
    if node.name in HEADINGS:
        return 0.0
    return (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def _blocks(node: Node) -> Iterator[tuple[Node, str, int]]:
    """``(innermost block element, text, characters inside links)`` of every run of inline text, in page order."""
    own, parts, linked = [node], [], 0
    stack: list[tuple] = [("in", node, False)]

    def flush():
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        return text

    while stack:
        kind, item, link = stack.pop()
        if kind == "text":
            parts.append(item)
            if link:
                linked += len(item.strip())
            continue
        block = item.name in BLOCK or item is node
        if block:
            if text := flush():
                yield own[-1], text, min(linked, len(text))
            linked = 0
        if kind == "out":
            if block:
                own.pop()
            continue
        if item.name == "br":
            parts.append(" ")
            continue
        if block:
            own.append(item)
        link = link or item.name == "a"
        stack.append(("out", item, link))
        stack += [("text", c, link) if isinstance(c, str) else ("in", c, link) for c in reversed(item.children)]


def main_text(page: str | None) -> str:
    """The article of a page, one block a line; empty for a null or empty page or one without text."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    blocks = list(_blocks(root))
    if not blocks:
        return ""
    touched: dict[int, Node] = {id(n): n for n, _, _ in blocks}
    for node, text, linked in blocks:
        node.length += len(text)
        node.linked += linked
        if node.name in HEADINGS:
            continue
        points = _points(node, text, linked)
        up, steps = node.parent if node.name in ("p", "pre", "li", "td", "blockquote") and node.parent else node, 1
        while up is not None and points >= LEAST * steps:
            up.score += points / steps
            touched[id(up)] = up
            up, steps = up.parent, steps + 1
    order = [root]
    for node in order:  # grows while it is read: parents before children
        order += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
    value = lambda n: n.score * (1 - n.linked / max(1, n.length)) * (1.25 if n.name in ("article", "main") else 1)
    best = max(touched.values(), key=value, default=root)
    inner = best
    while inner is not None and inner.name not in ("article", "main"):
        inner = inner.parent
    if inner is not None:  # an article is whole
        best = inner
    keep, limit = {id(best)}, max(10.0, 0.2 * value(best))
    own = set(best.attrs.get("class", "").split())
    for sibling in best.parent.children if best.parent and inner is None else []:
        if isinstance(sibling, Node) and sibling is not best and sibling.length:
            light = sibling.linked < 0.25 * sibling.length
            prose = sibling.name == "p" or sibling.name in HEADINGS
            alike = sibling.name == best.name and bool(own & set(sibling.attrs.get("class", "").split()))
            if value(sibling) >= limit or light and (prose or alike and sibling.length > 80):
                keep.add(id(sibling))
    if inner is not None:
        for other in touched.values():  # further parts of the article at any place
            if other.name == inner.name == "article" and value(other) >= 0.5 * value(inner):
                keep.add(id(other))
    around = _nearest(root, keep)
    return "\n".join(text for node, text, _ in blocks if around[id(node)] is not None)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` and its code points; any null in, null id and url or empty text out.

    Of equally good containers the first in page order wins; repeated pages give a row each, an empty table none.  Extra columns
    are ignored.
    """

    def work(columns: dict[str, list]) -> Iterator[dict[str, list]]:
        for at in range(0, len(columns["html"]), 500):
            found = [main_text(h) for h in columns["html"][at : at + 500]]
            part = {k: columns[k][at : at + 500] for k in ("page_id", "url")}
            yield {**part, "text": found, "n_chars": [len(t) for t in found]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(rows, work, "page_id long, url string, text string, n_chars long")
