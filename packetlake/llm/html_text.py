"""HTML extraction (operator 5): composite text density.

A page becomes a tree of elements and stretches of text. Each node's density is
its characters per tag, adjusted for links:

    C / T * log_b((C / LC) * (T / LT)),  b = ln(C / (C - LC) * LC + LCb / Cb * C + e)

(C characters, T tags, LC and LT those in links, LCb / Cb the body's share; zeros
count as one). The densities of its children add up, and the element with the
largest sum marks the article. The body's own density is the threshold: the mark
moves up its path towards the body as long as the next element is as dense, so
short headings and paragraphs around a long one come along. Every other subtree
or stretch of inline content that is as dense, wherever it stands, counts as a
part, and so does a heading whose section holds a part. As the density above
grows with the size of a subtree, one with the body's characters outside links
for each tag is dense as well.

Menus, headers, footers, sidebars, notices, adverts, scripts, styles and reader
comments are known by element or role; they have no density and no text. Words
of class and id (and a form around something) only weigh: densities count for a
quarter below a name that holds such a word, for a hundredth where it says
nothing else, and names of a state (``no-sidebar``, ``comments-open``) count for
nothing. The densest node is marked with these weights first. No element on its
path is boilerplate then, nor one of the same class as an element on it; other
named elements are. What is left of the article is never cut: blocks keep all
their text.

A null or empty page has an empty text, as has one without visible text. Tags
that are never closed end with their parent, a tag cut off by the page's end is
dropped. Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import map_texts

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Fixed values of HTML: elements without content, of raw content, that begin a block, and that end an open one of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}

BOILER_TAGS = frozenset("head nav footer aside button select input label dialog svg canvas audio video object embed menu script style noscript template textarea iframe title".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail footer masthead topbar toolbar comment comments commentlist disqus respond replies reply share sharing social related recommended newsletter subscribe subscription signup login widget pagination pager skip copyright".split()
)
#: Words that say no more about a place, and those that make a name one of a state.
PLACE_WORDS = frozenset("area bar block body bottom box button buttons container content form group header inner item items left link links list main outer page panel post right section site social top wrap wrapper".split())
STATE_WORDS = frozenset("no not has have with without is are can show hide enable disable open opened close closed ready enabled disabled on off visible hidden active toggled supported".split())
SOME, STRONG = 0.25, 0.01
KEPT = frozenset({"html", "body", "article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "kids", "parent", "boiler", "density", "total", "c", "t", "lc", "lt", "hc", "deep", "weight", "names")

    def __init__(self, tag: str, parent: Node | None, boiler: bool, weight: float = 1.0, names: str = ""):
        self.tag, self.parent, self.boiler, self.weight, self.names, self.kids = tag, parent, boiler, weight, names, []


def _boiler(tag: str, attributes: str, node: Node) -> bool:
    """Whether an element is boilerplate by its kind or role."""
    if tag in KEPT:
        return False
    if tag in BOILER_TAGS:
        return True
    if tag == "header":
        up = node
        while up is not None:
            if up.tag in ("article", "main"):
                return False
            up = up.parent
        return True
    return bool(attributes) and any(name.lower() == "role" and "".join(values).lower() in BOILER_ROLES for name, *values in ATTRIBUTE.findall(attributes))


def _named(tag: str, attributes: str) -> tuple[float, str]:
    """What an element's class and id leave of its weight, and these names."""
    weight, names = STRONG if tag == "form" else 1.0, []
    if tag not in KEPT and attributes and "=" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            if name.lower() == "role":
                continue
            names.append(value := "".join(values).lower())
            for one in value.split():
                words = [w for w in re.split("[^a-z]+", one) if w]
                if any(w in BOILER_WORDS for w in words) and words[0] not in STATE_WORDS and words[-1] not in STATE_WORDS:
                    weight = min(weight, STRONG if all(w in BOILER_WORDS or w in PLACE_WORDS for w in words) else SOME)
    return weight, " ".join(names)


def parse(page: str) -> Node:
    """The tree of a page: elements, and strings for its text."""
    root = Node("#root", None, False)
    node, at, n = root, 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            node.kids.append(page[at:])
            break
        if m.start() > at:
            node.kids.append(page[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag or (m[5] and not m[0].endswith(">")):
            continue
        tag = tag.lower()
        if close:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in ENDS_P:
            up = node
            while up is not root and (up.tag == "p" or up.tag not in BLOCK):
                if up.tag == "p":
                    node = up.parent
                    break
                up = up.parent
        if tag in SIBLING:
            up = node
            while up is not root and up.tag not in SCOPE[tag]:
                if up.tag in SIBLING[tag]:
                    node = up.parent
                up = up.parent
        new = Node(tag, node, node.boiler or _boiler(tag, attributes, node), *_named(tag, attributes))
        node.kids.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            node = new
    return root


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(k for k in reversed(x.kids) if isinstance(k, Node))
    return out


def _density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    if not c:
        return 0.0
    t, lc, lt = max(1, t), max(1, lc), max(1, lt)
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    value = (c / lc) * (t / lt)
    return c / t * (math.log(value) / math.log(base) if base > 1 and value > 1 else 1e-3)


def _measure(order: list[Node]) -> None:
    """Characters, tags, those in links and in headings, of every node."""
    for x in reversed(order):
        x.c = x.t = x.lc = x.lt = x.hc = 0
        # whether it is or holds a block
        x.deep = x.tag in BLOCK or any(k.deep for k in x.kids if isinstance(k, Node) and not k.boiler)
        if x.boiler:
            continue
        for k in x.kids:
            if isinstance(k, str):
                x.c += len(k.strip())
            elif not k.boiler:
                x.c += k.c
                x.t += k.t + 1
                x.lc += k.lc
                x.lt += k.lt + (k.tag == "a")
                x.hc += k.hc
        if x.tag == "a":
            x.lc = x.c
        if x.tag in HEADINGS:
            x.hc = x.c


def _densest(order: list[Node], share: float, weights: dict[int, float]) -> Node | None:
    """The element with the largest sum of its children's densities, by the weight of their characters (one, if not given)."""
    best, weighed = None, {}
    for x in reversed(order):
        w = weights.get(id(x), 1.0)
        x.density = _density(x.c, x.t, x.lc, x.lt, share)
        strings = [] if x.boiler else [len(k.strip()) for k in x.kids if isinstance(k, str)]
        kids = [k for k in x.kids if isinstance(k, Node) and not k.boiler and k.c]
        weighed[id(x)] = w * sum(strings) + sum(weighed[id(k)] for k in kids)
        x.total = w * sum(_density(n, 1, 0, 0, share) for n in strings) + sum(k.density * weighed[id(k)] / k.c for k in kids)
        if not x.boiler and x.c and (x.tag in BLOCK or x.tag == "#root") and (best is None or x.total >= best.total):
            best = x
    return best


def _judge_names(order: list[Node], body: Node) -> None:
    """Named elements become boilerplate, but for those on the path of the densest node and those of the same names."""
    if all(x.weight == 1 for x in order):
        return
    _measure(order)
    if not body.c:
        return
    weights: dict[int, float] = {}
    for x in order:
        weights[id(x)] = x.weight * (weights[id(x.parent)] if x.parent is not None else 1.0)
    up, path, names = _densest(order, body.lc / body.c, weights), set(), set()
    while up is not None:
        path.add(id(up))
        names.add((up.tag, up.names))
        up = up.parent
    for x in order:
        x.boiler = x.boiler or (x.parent is not None and x.parent.boiler) or (x.weight < 1 and id(x) not in path and not (x.names and (x.tag, x.names) in names))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    order = _order(parse(page))
    body = next((x for x in order if x.tag == "body"), order[0])
    _judge_names(order, body)
    _measure(order)
    if not body.c:
        return ""
    share = body.lc / body.c
    best = _densest(order, share, {})
    # up from it to below the body, as long as a node is denser than the body as a whole
    up = best.parent
    while up is not None and up.tag not in ("body", "html", "#root") and up.density >= body.density:
        best, up = up, up.parent
    line, up = set(), best
    while up is not None:
        line.add(id(up))
        up = up.parent
    blocks: list[str] = []
    for part in _parts(order[0], best, line, body, share):
        _blocks(part, blocks)
    return "\n\n".join(blocks)


def _units(x: Node, line: set[int]) -> list[list]:
    """The children of a node: each block alone, and the stretches of inline content between blocks."""
    out: list[list] = []
    inline = False
    for k in x.kids:
        block = isinstance(k, Node) and (k.deep or id(k) in line)
        if block or not inline:
            out.append([k])
        else:
            out[-1].append(k)
        inline = not block
    return out


def _parts(root: Node, best: Node, line: set[int], body: Node, share: float) -> list[list]:
    """What makes up the article, in page order: ``best``, all that is as dense as the body beside it, and the headings of these."""
    plain = (body.c - body.lc) / max(1, body.t)
    if best is root:
        return [[root]]
    units: dict[int, list[list]] = {}
    taken: set[int] = set()  # by the id of a unit, or of a node that is looked into and holds some
    todo, seen = [root], []
    while todo:
        x = todo.pop()
        seen.append(x)
        units[id(x)] = _units(x, line)
        for u in units[id(x)]:
            k = u[0]
            if k is best:
                taken.add(id(u))
            elif isinstance(k, Node) and (k.deep or id(k) in line):
                if k.boiler or not k.c:
                    continue
                if id(k) not in line and (k.density >= body.density or 0 < k.c - k.lc >= plain * max(1, k.t)):
                    taken.add(id(u))
                elif k.hc < k.c:
                    todo.append(k)
            else:
                nodes = [k for k in u if isinstance(k, Node) and not k.boiler]
                c = sum(len(k.strip()) for k in u if isinstance(k, str)) + sum(k.c for k in nodes)
                t, lc, lt = sum(k.t + 1 for k in nodes), sum(k.lc for k in nodes), sum(k.lt + (k.tag == "a") for k in nodes)
                if c and (_density(c, t, lc, lt, share) >= body.density or 0 < c - lc >= plain * max(1, t)):
                    taken.add(id(u))
    for x in reversed(seen):
        # 2: a part follows, 1: a heading taken follows, 0: neither
        follows = 0
        for u in reversed(units[id(x)]):
            k = u[0]
            if id(u) in taken or id(k) in taken:
                taken.add(id(x))
                follows = 2
            elif all(isinstance(k, str) and not k.strip() or isinstance(k, Node) and (k.boiler or not k.c) for k in u):
                continue
            elif isinstance(k, Node) and k.deep and k.hc == k.c:
                if follows:
                    taken.add(id(u))
                    follows = 1
            elif follows == 1:
                follows = 0
    out, todo = [], [[root]]
    while todo:
        u = todo.pop()
        if id(u) in taken:
            out.append(u)
        elif id(u[0]) in units:
            todo.extend(reversed(units[id(u[0])]))
    return out


def _blocks(part: list, blocks: list[str]) -> None:
    """The blocks of subtrees and stretches of text that stand together, in page order."""
    line: list[str] = []

    def flush():
        if line:
            if text := " ".join(html.unescape("".join(line)).split()):
                blocks.append(text)
            line.clear()

    todo: list = part[::-1]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif not x.boiler:
            if x.tag == "br":
                line.append(" ")
            elif x.tag in BLOCK:
                flush()
                todo.append(None)
                todo.extend(reversed(x.kids))
            else:
                todo.extend(reversed(x.kids))
    flush()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def make():
        def run(rows):
            out = [main_text(r) for r in rows]
            return {"text": out, "n_chars": [len(t) for t in out]}

        return run

    return map_texts(pages, html_col, [id_col, url_col], fields, make)
