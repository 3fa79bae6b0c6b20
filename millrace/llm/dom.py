"""A small forgiving HTML tree: elements, their text, and what a classifier sees of them."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import numpy as np

OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Where a tag ends, or where a quoted value in it begins.
STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe head".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose open element ends where one of these begins.
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option", "optgroup"}}
#: An open element of the first kind is not looked for beyond these.
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "p": {"div", "section", "article", "td", "body"}}

#: Attributes whose words may tell what an element is for.
NAMING = frozenset(["class", "id", "role", "aria-label", "data-role", "itemprop"])
TAGS = ["article", "main", "section", "div", "p", "li", "ul", "a", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "button", "label", "span"]
TAG_AT = {t: k for k, t in enumerate(TAGS)}
TAG_AT.update(dict.fromkeys(["ol", "menu", "dl"], TAG_AT["ul"]))
#: Kinds that an element of a name ends, and kinds it is a fence for.
ENDS = {n: [k for k in CLOSED_BY if n in CLOSED_BY[k]] for n in set().union(*CLOSED_BY.values())}
FENCED = {n: [k for k in FENCE if n in FENCE[k]] for n in set().union(*FENCE.values())}


class Node:
    __slots__ = ("tag", "parent", "children", "attrs", "parts", "depth", "place", "near")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node] = []
        #: Text and children in page order; None marks a place where a block ends.
        self.parts: list = []
        self.depth = parent.depth + 1 if parent else 0
        self.place = len(parent.children) if parent else 0
        #: The open element of each kind in ``CLOSED_BY`` that an end may reach from here.
        self.near: dict[str, Node] = parent.near if parent else {}
        if tag in FENCED or tag in CLOSED_BY:
            fenced = FENCED.get(tag, ())
            self.near = {k: x for k, x in self.near.items() if k not in fenced}
            if tag in CLOSED_BY:
                self.near[tag] = self
        if parent:
            parent.children.append(self)
            parent.parts.append(self)


class _Scanner:
    """Finds tags in one pass: what is looked for and does not come again is not looked for twice."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.last_end = page.rfind(">")
        self.quotes = True  # until one is left open: from there on quotes count for nothing
        self.absent: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; some ``>`` follows."""
        if self.quotes:
            pos = at
            while m := STOP.search(self.page, pos):
                if m[1] is None:
                    return m.start()
                close = self.page.find(m[1], m.end())
                if close < 0:
                    break
                pos = close + 1
            self.quotes = False
        return self.page.find(">", at)

    def raw_end(self, name: str, at: int) -> int | None:
        """Where the text of a raw element ends with its end tag; None if that never comes."""
        if name in self.absent:
            return None
        m = _raw_end(name).search(self.page, at)
        if m is None:
            self.absent.add(name)
            return None
        return m.end()


@lru_cache(maxsize=32)
def _raw_end(name: str) -> re.Pattern:
    if name == "head":  # its end may be left out
        return re.compile(r"</head\s*>|(?=<body\b)", re.I)
    return re.compile(rf"</{name}\s*>", re.I)


def parse(page: str) -> Node:
    """The tree of a page; never fails, whatever is left open or closed twice, and takes time in proportion to its length."""
    root = here = Node("#page", None)
    scan = _Scanner(page)
    is_open: Counter[str] = Counter()
    at = text = 0  # where to look on, and where text not yet taken begins

    def close(upto: Node) -> Node:
        x = here
        while True:
            is_open[x.tag] -= 1
            if x is upto:
                return x.parent
            x = x.parent

    while True:
        begin = page.find("<", at)
        if begin < 0 or begin > scan.last_end:
            break
        follows = page[begin + 1 : begin + 2]
        m = None if follows in ("!", "?") else OPENING.match(page, begin)
        if m is None and follows not in ("!", "?"):
            at = begin + 1
            continue
        if begin > text:
            here.parts.append(page[text:begin])
        if m is None:
            mark = "-->" if page.startswith("<!--", begin) else ">"
            end = page.find(mark, begin + (4 if mark == "-->" else 1))
            at = text = end + len(mark) if end >= 0 else scan.size
            continue
        end = scan.tag_end(m.end())
        attrs = page[m.end() : end]
        at = text = end + 1
        name = m[2].lower()
        if m[1]:
            if is_open[name]:
                up = here
                while up.tag != name:
                    up = up.parent
                here = close(up)
            continue
        if name in RAW:
            end = scan.raw_end(name, at)
            if end is None:
                end = scan.size if name in ("script", "style") else at
            at = text = end
            continue
        for kind in ENDS.get(name, ()):
            if kind in here.near:
                here = close(here.near[kind])
        node = Node(name, here, attrs)
        drawn = name in ("svg", "math") or is_open["svg"] or is_open["math"]
        if name not in VOID and not (drawn and attrs.endswith("/")):
            is_open[name] += 1
            here = node
    if text < scan.size:
        here.parts.append(page[text:])
    return root


def walk(root: Node) -> list[Node]:
    """All elements, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def attribute_words(attrs: str) -> set[str]:
    """Lower-cased words of the attributes that name things, each with its tag-like parts and as a whole."""
    found: set[str] = set()
    if attrs and not attrs.isspace():
        for m in ATTRIBUTE.finditer(attrs):
            if m[1].lower() in NAMING:
                for word in (m[2] or m[3] or m[4] or "").split():
                    found.add(word.lower())
                    found.update(p.lower() for p in NAME_PART.findall(word) if len(p) > 1)
    return found


FEATURES = 24 + 2 * len(TAGS)
#: Elements whose features are made at a time.
ROWS = 1 << 15
#: Sum, least and most of what an element's words say, and of its ancestors'.
NOTHING = (0.0,) * 6


def features(nodes: list[Node], words: Mapping[str, float], ignore: Callable[[], bool] | None = None) -> Iterator[np.ndarray]:
    """One row per element, some elements at a time; ``nodes`` as ``walk`` gives them.

    ``words`` says by log-odds how much a word in an attribute, or a tag's name in
    angle brackets, speaks for main text; an element for which ``ignore`` is true
    counts as having no attributes.
    """
    n = len(nodes)
    number = {id(x): k for k, x in enumerate(nodes)}
    own, stops, parent, tag, above, told, linked = [0] * n, [0] * n, [0] * n, [-1] * n, [0] * n, [NOTHING] * n, [False] * n
    for k, x in enumerate(nodes):
        if x.parts:
            text = "".join(p for p in x.parts if p.__class__ is str)
            if text:
                own[k] = len(text) - text.count(" ")
                stops[k] = text.count(". ") + text.count(".\n") + text.rstrip().endswith((".", "!", "?"))
        tag[k] = TAG_AT.get(x.tag, -1)
        so_far = 0.0, 0.0, 0.0
        if k:
            p = parent[k] = number[id(x.parent)]
            above[k], linked[k] = above[p] | (1 << tag[p] if tag[p] >= 0 else 0), linked[p]
            a, b, c, d, e, f = told[p]
            so_far = d + a, min(e, b), max(f, c)
        said = [words[w] for w in attribute_words(x.attrs) if w in words] if x.attrs and not (ignore and ignore()) else []
        if (name := f"<{x.tag}>") in words:
            said.append(words[name])
        told[k] = (sum(said), min(said), max(said), *so_far) if said else (0.0, 0.0, 0.0, *so_far)
        linked[k] = linked[k] or x.tag == "a"
    chars, tags = list(own), [1] * n
    links = [c if u else 0 for c, u in zip(own, linked)]
    paras, breaks = [int(x.tag == "p") for x in nodes], [int(x.tag == "br") for x in nodes]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        links[p] += links[k]
        tags[p] += tags[k]
        paras[p] += paras[k]
        stops[p] += stops[k]
        breaks[p] += breaks[k]
    own, chars, tags, links, paras, stops, breaks = (np.array(v, dtype=float) for v in (own, chars, tags, links, paras, stops, breaks))
    parent, tag, above, told = np.array(parent), np.array(tag), np.array(above), np.array(told)
    order_place = np.array([x.place for x in nodes], dtype=float)
    start = np.concatenate(([0], np.cumsum(own)[:-1]))
    total = max(chars[0], 1.0)
    brothers = np.array([len(x.parent.children) if x.parent else 1 for x in nodes], dtype=float)
    headings = np.array([x.tag in HEADINGS for x in nodes])
    depth = np.array([x.depth for x in nodes])
    for at in range(0, n, ROWS):
        r = slice(at, min(n, at + ROWS))
        p = parent[r]
        out = np.zeros((len(p), FEATURES), dtype=np.float32)
        out[:, 0] = np.log1p(chars[r])
        out[:, 1] = np.log1p(own[r])
        out[:, 2] = links[r] / np.maximum(chars[r], 1)
        out[:, 3] = np.log1p(chars[r] / tags[r])
        out[:, 4] = chars[r] / total
        out[:, 5] = chars[r] / np.maximum(chars[p], 1)
        out[:, 6] = depth[r]
        out[:, 7] = order_place[r]
        out[:, 8] = brothers[r]
        out[:, 9] = order_place[r] / brothers[r]
        out[:, 10] = start[r] / total
        out[:, 11] = np.log1p(paras[r])
        out[:, 12] = stops[r] / np.maximum(chars[r], 1) * 100
        out[:, 13] = np.log1p(stops[r])
        out[:, 14] = np.log1p(chars[p] / tags[p])
        out[:, 15] = links[p] / np.maximum(chars[p], 1)
        out[:, 16] = headings[r]
        out[:, 17] = breaks[r]
        out[:, 18:24] = told[r]
        rows = np.flatnonzero(tag[r] >= 0)
        out[rows, 24 + tag[r][rows]] = 1
        out[:, 24 + len(TAGS) :] = above[r, None] >> np.arange(len(TAGS)) & 1
        yield out


def weights(nodes: list[Node]) -> np.ndarray:
    """Letters of each element's own text."""
    return np.array([sum(len(p) - p.count(" ") - p.count("\n") for p in x.parts if isinstance(p, str)) for x in nodes], dtype=float)


def blocks(root: Node, kept: set[int]) -> list[str]:
    """Texts of the blocks, in page order, from the elements that are kept (by id)."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, tuple):
            held.append(x[0])
        else:
            if x.tag == "br":
                held.append(" ")
            block = x.tag in BLOCK
            if block:
                end()
            keep = id(x) in kept
            inside: list = [(p,) if isinstance(p, str) else p for p in x.parts if keep or not isinstance(p, str)]
            stack.extend(reversed([*inside, None] if block else inside))
    end()
    return out
