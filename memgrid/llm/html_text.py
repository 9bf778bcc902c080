"""HTML extraction by tree scoring.

A page becomes a tree (tags close as browsers close them). Every block of text has points (one, one for each comma, and one for each
hundred characters, up to three), discounted by the share of its text that is link text, and passes them to its ancestors: its parent
the whole, each further one of LEVELS a share. Names only discount: an element whose tag, role, class or id speaks of page furniture
passes on a part of its points, little where the name leaves no doubt, more where the word has other uses or stands beside one that isn't
known. The element with the most points is the article's container. From there upwards, up to the article or the body, siblings with
a fair part of its points are kept with it, and what is text by its tag. Within what is kept a discounted element stays if its discounted
points are worth it. Of what is kept all blocks are put out, in page order, but for list items and bare boxes that are links alone, unless
these are titles by their length.

Menus and what is hidden (nav, button, dialog; hidden, display: none) are never looked at, scripts and styles neither. A form or fieldset is
left out if its controls outweigh the points of its text, so one around the whole page isn't.

Defined results: null, empty or textless html gives an empty text; unclosed and stray tags are closed or dropped; a page without any
container that stands out gives all its text outside of furniture; repeated rows each get their result; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

# HTML's own classes of tags, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math canvas object audio video head select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: Tags that are never article text.
NEVER = frozenset("nav button dialog menu".split())
#: Elements that hold controls, and the controls; one counts as much as CONTROL points of text.
FORMS = frozenset("form fieldset".split())
CONTROLS = frozenset("input select textarea button".split())
CONTROL = 3.0
#: Tags that are text wherever the article is.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr br".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id that leave no doubt, and words that articles use as well.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors navbar navigation nav breadcrumb breadcrumbs sidebar sidebars masthead topbar bottombar toolbar cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe signup login signin comment comments commentlist discussion discussions disqus replies pagination pager outbrain taboola footer".split()
)
MILD = frozenset(
    "promo promotion promoted banner menu menus aside header notice notices alert alerts subscription reply respond reactions share sharing social related recommended recommendations widget skip search rail "
    "disclaimer copyright legal reader responses feedback form".split()
)
#: Words that say what an element is laid out like, or that it is the article's.
GOOD = frozenset("article body content entry main post story text has no with without layout".split())
#: Words that say nothing of what is in an element.
PLAIN = frozenset("area bar block bottom box button buttons col column container group holder inner item items left links list outer panel right row section site page thread threads top wrap wrapper".split())
#: What a name leaves of an element's points: no doubt, a word with other uses alone, and beside a word that isn't known.
SURE, ALONE, BESIDE = 0.005, 0.1, 0.4
#: Discounted points for which a discounted element stays within the article.
LEAST = 1.5
#: Ancestors that a block passes points to.
LEVELS = 8
MENU = frozenset("ul ol li div td tr dd dt".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A tag's attributes: a quote opens a value only after an equals sign, as HTML has it.
ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)(" + ATTRIBUTES + r")(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
HIDDEN_INPUT = re.compile(r"type\s*=\s*[\"']?hidden", re.I)
SPACE = re.compile(r"\s+")
#: A list of links alone is text from this mean length of an item on: titles, not names of a menu's pages.
TITLE = 24


class Node:
    __slots__ = ("children", "controls", "drop", "factor", "keep", "links", "name", "parent", "points", "raw", "size")

    def __init__(self, name: str, parent: Node | None, drop: bool, factor: float = 1.0):
        self.name, self.parent, self.drop, self.factor = name, parent, drop, factor
        self.children: list[Node | str] = []
        self.points = self.raw = 0.0
        self.size = self.links = self.controls = 0
        self.keep = False


def named(value: str) -> float:
    """What a class or id leaves of the points."""
    out = 1.0
    for one in value.split():
        words = {w.lower() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", one) if w and not w.isdigit()}
        if words & GOOD and not words & STRONG - {"footer", "masthead"}:
            continue
        if words & GOOD & {"has", "no", "with", "without", "layout"}:
            continue
        rest = words - STRONG - MILD - PLAIN - GOOD
        if words & STRONG:
            out = min(out, BESIDE if rest and len(words & STRONG) < len(rest) else SURE)
        elif words & MILD:
            out = min(out, BESIDE if rest else ALONE)
    return out


def discount(name: str, attributes: str, within: bool) -> float:
    """What an element passes on of its points; 0 if it is never looked at. within: it is part of an article element."""
    if name in NEVER:
        return 0.0
    out = 1.0
    if name in ("header", "footer", "aside"):
        out = ((BESIDE if attributes.strip(" /") else 1.0) if name == "aside" else SURE if name == "footer" else 1.0) if within else SURE
    if not attributes or name in ("html", "body", "article", "main"):
        return out
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and HIDDEN.search(value)):
            return 0.0
        if key == "role" and value.lower() in ROLES:
            out = min(out, SURE)
        elif key in ("class", "id"):
            out = min(out, named(value))
    return out


def tree(page: str) -> Node:
    root = at = Node("#root", None, False)
    place = articles = 0
    while True:
        m = TOKEN.search(page, place)
        text = page[place : m.start()] if m else page[place:]
        if text:
            at.children.append(html.unescape(text))
        if not m:
            return root
        place = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in CONTROLS and not m[1] and not HIDDEN_INPUT.search(m[3] or ""):
            up = at
            while up is not root and up.name not in FORMS:
                up = up.parent
            up.controls += 1
        if m[1]:
            up = at
            while up is not root and up.name != name:
                if name in INLINE and up.name not in INLINE:
                    break
                up = up.parent
            if up is not root and up.name == name:
                articles -= name == "article" and articles > 0
                at = up.parent
            elif name == "p":
                at.children.append(Node("p", at, False))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*(?:[^>]*)>", re.I).search(page, place) if not (m[3] or "").rstrip().endswith("/") else m
            if name not in ("head", "title"):
                at.children.append(Node("#gap", at, True)) if name not in ("svg", "math", "script", "style") else None
            place = (m.end() if name == "head" else len(page)) if end is None else end.end()
            continue
        if name in ENDS_P:
            up = at
            while up is not root and (up.name in INLINE or up.name == "p"):
                if up.name == "p":
                    at = up.parent
                    break
                up = up.parent
        if name in SAME:
            up, stop = at, SCOPES.get(name, {"table"})
            while up is not root and up.name not in stop:
                if up.name in SAME[name]:
                    at = up.parent
                up = up.parent
        factor = discount(name, m[3] or "", articles > 0)
        node = Node(name, at, at.drop or not factor, factor)
        at.children.append(node)
        if name not in VOID and not (m[3] or "").rstrip().endswith("/"):
            articles += name == "article"
            at = node


def blocks(node: Node, out: list) -> None:
    """(block's parent, text, length of link text) of the wanted text below node, in page order."""
    text: list[str] = []
    links = 0
    stack: list = [(node, iter(node.children), node.name == "a")]
    owner = node

    def flush() -> None:
        nonlocal links
        line = SPACE.sub(" ", "".join(text)).strip()
        if line:
            out.append((owner, line, min(links, len(line))))
        text.clear()
        links = 0

    while stack:
        at, rest, link = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if at.name not in INLINE:
                flush()
                owner = stack[-1][0] if stack else node
                k = len(stack) - 1
                while k > 0 and stack[k][0].name in INLINE:
                    k -= 1
                owner = stack[k][0] if stack else node
        elif isinstance(child, str):
            text.append(child)
            links += len(child.strip()) if link else 0
        elif child.drop:
            if child.name not in INLINE:
                flush()
        elif child.name == "br":
            text.append("\n")
        elif child.name in VOID:
            if child.name == "hr":
                flush()
        else:
            if child.name not in INLINE:
                flush()
                owner = child
            stack.append((child, iter(child.children), link or child.name == "a"))
    flush()


def points_of(line: str, links: int) -> float:
    return (1 + line.count(",") + min(len(line) / 100, 3)) * (1 - links / len(line))


def without_forms(root: Node, found: list) -> list:
    """What is left of found without the forms whose controls outweigh their points; a form around the page isn't one of these."""
    forms = [n for n in in_order(root) if n.name in FORMS]
    if not forms:
        return found
    points = {id(n): 0.0 for n in forms}
    for owner, line, links in found:
        up = owner
        while up is not None:
            if id(up) in points:
                points[id(up)] += points_of(line, links)
            up = up.parent
    for n in reversed(forms):
        up = n.parent
        while up is not None and up.name not in FORMS:
            up = up.parent
        if points[id(n)] <= CONTROL * max(n.controls, n.name == "form"):  # a form counts as a control itself
            n.drop = True
        elif up is not None:
            up.controls += n.controls
    gone = {id(n) for n in forms if n.drop}

    def stays(at: Node | None) -> bool:
        while at is not None:
            if id(at) in gone:
                return False
            at = at.parent
        return True

    return [x for x in found if stays(x[0])] if gone else found


def in_order(root: Node) -> list[Node]:
    """All nodes that aren't dropped, parents before children."""
    out, stack = [], [root]
    while stack:
        at = stack.pop()
        out.append(at)
        stack.extend(x for x in reversed(at.children) if isinstance(x, Node) and not x.drop)
    return out


def scored(root: Node, found: list) -> list[Node]:
    """Sets points, sizes and raw points (discounted, of all below) of all nodes; gives the nodes in order."""
    nodes = in_order(root)
    passed: dict[int, float] = {}
    for n in nodes:  # what is left of a block's points after all names above it
        passed[id(n)] = n.factor * (passed[id(n.parent)] if n.parent is not None else 1.0)
    for owner, line, links in found:
        points = points_of(line, links) * passed[id(owner)]
        owner.raw += points
        owner.size += len(line)
        owner.links += links
        up = owner.parent if owner.name in TEXTS or owner.name in ("td", "li", "dd", "dt") else owner
        for depth in range(1, LEVELS + 1):
            if up is None:
                break
            up.points += points / depth
            up = up.parent
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.raw += n.raw
            n.parent.size += n.size
            n.parent.links += n.links
    return nodes


def linked(n: Node) -> float:
    return n.links / max(n.size, 1)


def companions(of: Node, beside: Node | None, least: float) -> list[Node]:
    """The children of an element that are kept with the one of them that is the article, or holds it."""
    out = []
    for x in of.children:
        if isinstance(x, Node) and not x.drop and x is not beside and x.size and linked(x) < 0.3 and (x.factor == 1 or x.raw >= LEAST):
            if x.name in INLINE or x.raw >= least or (x.name in TEXTS and (of.name not in ("body", "html", "#root") or x.name in ("p", "h1") or x.raw >= 2)):
                out.append(x)
    return out


def extracted(page: str | None) -> str:
    """The page's main text, its blocks joined by one space."""
    if not page:
        return ""
    root = tree(page)
    found: list = []
    blocks(root, found)
    found = without_forms(root, found)
    if not found:
        return ""
    nodes = scored(root, found)

    def worth(n: Node) -> float:
        return n.points * (1.25 if n.name in ("article", "main") else 1.0) * (1 - linked(n))

    best = max((n for n in nodes if n.name not in ("#root", "html")), key=worth, default=root)
    while best.parent is not None and best.name in TEXTS | {"tbody", "tr", "li", "td", "th", "dd", "dt"} | INLINE:
        best = best.parent
    own = {id(best)}  # elements whose own text is the article's
    if best.name in ("body", "html", "#root"):
        best.keep = True
        most = max((x.raw for x in best.children if isinstance(x, Node)), default=0.0)
        kept = companions(best, None, max(2.0, most * 0.2))
        for x in best.children if kept else []:
            if isinstance(x, Node) and not any(x is k for k in kept):
                x.drop = True
    else:
        best.keep, at = True, best
        while at.parent is not None and at.name not in ("article", "body", "html", "#root"):
            kept = companions(at.parent, at, max(2.0, best.raw * 0.2))
            for x in kept:
                x.keep = True
            if kept and at.parent.name not in ("body", "html", "#root"):
                own.add(id(at.parent))
            at = at.parent
    for n in nodes:
        if n.parent is not None:
            n.keep = n.keep or n.parent.keep
            if n.drop or (n is not best and n.factor < 1 and n.keep and (n.raw < LEAST or linked(n) > 0.33)):
                n.keep = False
                n.drop = True
            if n.parent.drop:
                n.keep, n.drop = False, True
    chosen = [x for x in found if x[0].keep or id(x[0]) in own]
    return " ".join(line for (_, line, _), bare in zip(chosen, menus(chosen), strict=True) if not bare)


def menus(chosen: list) -> list[bool]:
    """Which blocks are items of menus: link text alone in list items and bare boxes. Items that follow each other are judged together: a
    list of titles (references, further reading) isn't a menu."""
    out = [owner.name in MENU and links >= 0.9 * len(line) for owner, line, links in chosen]
    at = 0
    while at < len(out):
        end = at
        while end < len(out) and out[end] and chosen[end][0].name == chosen[at][0].name and chosen[end][0].parent is chosen[at][0].parent:
            end += 1
        if end > at and chosen[at][0].name in ("li", "dd", "dt") and sum(len(x[1]) for x in chosen[at:end]) >= TITLE * (end - at):
            out[at:end] = [False] * (end - at)
        at = max(end, at + 1)
    return out


def main_texts(pages: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and the main text of each row's html."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.slices(batches, "html"):
            texts = [extracted(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    return pages.select(*keep, "html").mapInArrow(f, f"{kinds}, text string")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_texts(pages, "page_id", "url").withColumn("n_chars", F.length("text").cast("long"))
