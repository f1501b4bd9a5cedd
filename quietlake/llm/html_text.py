"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks. A classifier, fitted to a bounded sample of labelled blocks
(:mod:`.page_sample`), gives each block the log-odds of being content, from its text and from what
the elements around it are called; they are the capacities from the source and to the sink.
Neighbours in page order, and blocks with one parent, are joined by smoothness edges that are
weaker the further apart they stand in the tree. The minimum cut, by maximum flow, separates
content from boilerplate. No single cue weighs more than the strongest edge, so that what a block
is called can be outweighed by what it stands among.
"""

from __future__ import annotations

import functools
import html
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Elements whose content is never text.
SKIP = frozenset("script style noscript template head title iframe object select option textarea button canvas audio video datalist".split())
#: Those whose content isn't markup and ends at their own end tag alone.
RAW = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset("html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset blockquote pre figure figcaption address details summary dialog hr menu search legend center".split())
#: Elements that a new one of the same group closes.
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
#: What an implied end must not reach beyond.
SCOPE = frozenset("ul ol dl table html body div article section main nav aside header footer form menu".split())

#: Elements and roles that hold no article.
AROUND_TAGS = frozenset("nav aside footer form menu dialog search header".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar status".split())
#: Words of class and id names: what isn't article, what is, what says where something stands, and what names a layout by what it has.
BAD_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adbox banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup popup modal overlay sidebar sidebars related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation topbar footer header masthead comment comments commentlist disqus reply replies respond reactions pagination pager widget widgets toolbar login search searchbox copyright legal disclaimer toc skip skiplink hidden".split())
GOOD_NAMES = frozenset("article content main post entry story body text prose".split())
PLACE_NAMES = frozenset("area bar block bottom box button buttons col column container cta form global group holder icons inner item items left link links list middle module outer page panel primary reader readers region right row secondary section site slot strip tools top unit user users visitor wide wrap wrapper".split())
LAYOUT_NAMES = frozenset("with has no without and".split())
#: The strongest edge joins blocks of one element; each step between two elements halves it, and two of different kinds stand two steps further apart.
STRONGEST, SIBLING = 6.0, 0.25
#: The most that one cue of the classifier weighs.
CUE = 6.0
#: What the classifier sees of a block, in this order.
FEATURES = ("bias", "length", "sentence", "links", "heading", "paragraph", "article", "around", "role", "named", "half_named", "well_named")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Cues:
    """What an element and those above it say: how many are of a kind."""

    around: int = 0
    role: int = 0
    named: int = 0
    half_named: int = 0
    well_named: int = 0


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    depth: int
    cues: Cues
    in_article: bool
    link: bool
    hidden: bool = False


@dataclass(slots=True)
class Block:
    text: str
    at: Node
    links: float = 0.0


def judged_name(name: str, in_article: bool) -> str | None:
    """named, half_named (with other words, as in "share-price"), well_named, or None, of a class or id.

    A header within an article, or named after one, has the headline and says nothing; nor does a
    layout that is named by what it has.
    """
    words = {x.lower() for x in _NAME_WORD.findall(name)}
    good = bool(words & GOOD_NAMES)
    bad = words & BAD_NAMES
    if bad == {"header"} and (in_article or good):
        bad = set()
    if not bad:
        return "well_named" if good else None
    if words & LAYOUT_NAMES:
        return None
    return "named" if words <= BAD_NAMES | PLACE_NAMES | GOOD_NAMES else "half_named"


def _cues(tag: str, attrs: str, parent: Node) -> Cues | None:
    """The cues of an element and those above it; None if it is hidden."""
    c = parent.cues
    out = Cues(c.around, c.role, c.named, c.half_named, c.well_named)
    if tag in AROUND_TAGS and not (tag == "header" and parent.in_article):  # an article's own header has its headline
        out.around += 1
    if "=" not in attrs and "hidden" not in attrs:
        return out
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return None
        if name == "role":
            out.role += value.strip().lower() in AROUND_ROLES
        elif name in ("class", "id") and tag not in ("html", "body"):
            found = {judged_name(x, parent.in_article) for x in value.split()}
            out.named += "named" in found
            out.half_named += "half_named" in found and "named" not in found
            out.well_named += "well_named" in found and not found & {"named", "half_named"}
    return out


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, with white space as single spaces."""
    root = Node("", None, 0, Cues(), False, False)
    stack, out = [root], []
    text: list[str] = []
    linked = total = 0

    def flush(path: list[Node]) -> None:
        nonlocal linked, total
        if total:
            s = _SPACE.sub(" ", "".join(text)).strip()
            if s:
                at = next(n for n in reversed(path) if not n.hidden and n.tag in BLOCK or n.parent is None)
                out.append(Block(s, at, linked / total))
        text.clear()
        linked = total = 0

    def add(raw: str) -> None:
        nonlocal linked, total
        if raw and not stack[-1].hidden:
            s = html.unescape(raw)
            text.append(s)
            if n := len(s.strip()):
                total += n
                if stack[-1].link:
                    linked += n

    pos, skip, end = 0, None, len(page)
    while pos < end:
        if skip:
            # the content of a raw element ends at its own end tag
            m = re.compile(rf"</{re.escape(skip)}\s*>", re.I).search(page, pos)
            pos, skip = (m.end() if m else end), None
            continue
        m = _TOKEN.search(page, pos)
        if not m:
            add(page[pos:])
            break
        add(page[pos : m.start()])
        pos = m.end()
        if m[1] is not None:
            add(m[1].replace("&", "&amp;"))
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attrs = m[2] or m[5], m[4] or m[7] or ""
        if closing:
            own = next((n for n in reversed(stack[1:]) if n.tag == tag), None)
            if (tag in BLOCK or tag == "body") and not (own or stack[-1]).hidden:
                flush(stack)
            if own:
                while stack.pop() is not own:
                    pass
            continue
        if tag == "br":
            if not stack[-1].hidden:
                text.append(" ")
            continue
        if tag in BLOCK:
            path = stack[:]
            if tag in CLOSES:
                _close(stack, CLOSES[tag])
            if any(n.tag == "p" for n in stack[-6:]):
                _close(stack, frozenset(["p"]))
            if not stack[-1].hidden:
                flush(path)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        parent = stack[-1]
        cues = _cues(tag, attrs, parent)
        if tag in RAW:
            skip = tag
            continue
        if tag == "head":
            # up to its end tag or the body
            b = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, pos)
            pos = b.end() if b else pos
            continue
        hidden = parent.hidden or cues is None or tag in SKIP
        stack.append(Node(tag, parent, parent.depth + 1, cues or parent.cues, parent.in_article or tag in ("article", "main"), parent.link or tag == "a", hidden))
    flush(stack)
    return out


def _close(stack: list[Node], tags: frozenset[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in SCOPE or stack[i].tag in SKIP:
            return


def features(b: Block) -> list[float]:
    """:data:`FEATURES` of a block, each from 0 to 1."""
    c, tag = b.at.cues, b.at.tag
    return [1.0, min(1.0, len(b.text) / 200), float(b.text[-1] in ".!?\u2026\"\u201d\u00bb:"), b.links, float(len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()), float(tag == "p"), float(b.at.in_article), float(c.around > 0), float(c.role > 0), float(c.named > 0), float(c.half_named > 0), float(c.well_named > 0)]


def fit(x: np.ndarray, y: np.ndarray, most: float = CUE, decay: float = 0.5, steps: int = 25) -> np.ndarray:
    """Weights of a logistic classifier by Newton's method, none over ``most``: one that would be is held there while the rest are fitted again."""
    w = np.zeros(x.shape[1])
    free = np.ones(len(w), bool)
    while True:
        some = x[:, free]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (some.T * (p * (1 - p))) @ some + decay * np.eye(some.shape[1])
            w[free] -= np.linalg.solve(h, some.T @ (p - y) + decay * w[free])
        over = free & (np.abs(w) > most)
        if not over.any():
            return w
        w[over] = np.sign(w[over]) * most
        free &= ~over


@functools.cache
def weights() -> tuple[float, ...]:
    """The classifier, fitted once a process to the labelled sample."""
    from .page_sample import labelled_pages

    x, y = [], []
    for page, label in labelled_pages():
        for b in blocks(page):
            x.append(features(b))
            y.append(label(b.text))
    return tuple(fit(np.array(x), np.array(y, float)).tolist())


def log_odds(b: Block, w: tuple[float, ...]) -> float:
    """A block's capacity: to the source if positive, to the sink if negative."""
    return sum(a * f for a, f in zip(w, features(b), strict=True))


def distance(a: Node, b: Node) -> int:
    """Steps between two elements in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, STRONGEST * 0.5 ** (distance(found[i - 1].at, b.at) + 2 * (found[i - 1].at.tag != b.at.tag))))
        key = id(b.at.parent if b.at.parent is not None else b.at)
        if (j := last.get(key)) is not None and j != i - 1:
            out.append((j, i, SIBLING))
        last[key] = i
    return out


def min_cut(weights: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side: the labelling of least cost.

    A node's positive weight is the capacity from the source, a negative one that to the sink.
    A node whose weight exceeds all its edges takes the side of its weight whatever the others do;
    such nodes are contracted into source or sink before the flow is computed.
    """
    n = len(weights)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, c in links:
        near[a].append((b, c))
        near[b].append((a, c))
    w = list(weights)
    free = [sum(c for _, c in x) for x in near]
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is None and abs(w[i]) > free[i]:
            side[i] = w[i] > 0
            for j, c in near[i]:
                if side[j] is None:
                    w[j] += c if side[i] else -c
                    free[j] -= c
                    todo.append(j)
    if None in side:
        rest = [i for i in range(n) if side[i] is None]
        place = {x: k for k, x in enumerate(rest)}
        inner = [(place[a], place[b], c) for a, b, c in links if a in place and b in place]
        for x, s in zip(rest, _flow([w[i] for i in rest], inner), strict=True):
            side[x] = s
    return [bool(x) for x in side]


def _flow(weights: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Maximum flow by shortest augmenting paths; True where the residual graph is reached from the source."""
    n = len(weights)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((c, back))

    for i, w in enumerate(weights):
        if w > 0:
            add(s, i, w, 0.0)
        elif w < 0:
            add(i, t, -w, 0.0)
    for a, b, c in links:
        add(a, b, c, c)
    while True:
        via = {s: -1}
        queue = deque([s])
        while queue and t not in via:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and to[e] not in via:
                    via[to[e]] = e
                    queue.append(to[e])
        if t not in via:
            return [i in via for i in range(n)]
        path, at = [], t
        while at != s:
            path.append(via[at])
            at = to[via[at] ^ 1]
        flow = min(cap[e] for e in path)
        for e in path:
            cap[e] -= flow
            cap[e ^ 1] += flow


def main_text(page: str, w: tuple[float, ...] | None = None) -> str:
    """The content blocks of a page, joined by line ends."""
    found = blocks(page)
    if not found:
        return ""
    w = w or weights()
    keep = min_cut([log_odds(b, w) for b in found], edges(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


NEW = [T.StructField("text", T.StringType(), False)]


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with text instead of html.

    Null and empty pages, and pages without content, have an empty text. Pages of any length are
    parsed whole, broken markup included. Repeated rows give equal results; other columns aren't
    read; an empty table gives no rows.
    """

    fitted = weights()

    def make():
        def work(_: pa.RecordBatch, texts: list[bytes]) -> list:
            return [[main_text(x.decode("utf-8", "replace"), fitted) for x in texts]]

        return work

    return common.map_text(pages.select("page_id", "url", "html"), "html", make, NEW).drop("html")
