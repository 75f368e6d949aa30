"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of block elements, with the end tags that HTML
lets writers leave out put in. Each element gets features: its tag, depth, the
tokens of its class, id and role, text and link length of its subtree, tags per
character, paragraphs, children and siblings and its place among them, and the
same of its parent. Boosted trees give each element the log-odds of belonging
to the main text. Decoding is hierarchical: from the root down, an element that
is judged to be outside takes its whole subtree with it, and an element judged
inside decides for descendants that are not judged outside with confidence. So
no text is kept inside a dropped ancestor, and no ancestor of kept text is
contradicted.

The trees are trained here, on pages that ``training_page`` writes from a seed:
articles of many layouts with menus, headers, footers, sidebars, notices,
adverts, forms and comments around and inside them, labelled as they are
written. Training reads no page of the corpus, takes a bounded, documented
number of pages (``TRAINING_PAGES``) and always gives the same model.

Output text: character references decoded, white space inside a block turned
into one space and trimmed, blocks joined in page order by two newlines.

Defined results: null and empty pages give the empty string, as do pages without
main text; each run of text directly in the body is an element of its own, which
is judged like the others; elements that are hidden, and buttons, have no text;
unclosed and stray tags are repaired; a tag that never ends takes the rest of the
page, an attribute's quote that never ends is part of its value; repeated rows are extracted each; further columns are
ignored. Pages are used whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TRAINING_PAGES = 900
SEED = 4_271
ROUNDS, DEPTH, RATE, BINS = 50, 5, 0.25, 32
#: Log-odds below which an element inside a kept one is dropped.
CONFIDENT = -0.5

# Element groups of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg iframe object canvas textarea select option datalist annotation annotation-xml audio video button".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A new element of the key's kind ends an open paragraph.
ENDS_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot".split())
#: An open element of the key ends where one of its values begins; the last set stops the search.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements that hold one piece of an article's text.
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th figcaption".split())
TAG_GROUPS = (
    ("p", "pre", "blockquote"), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "dd", "dt"), ("ul", "ol", "dl", "menu", "dir"), ("article",), ("main",),
    ("section",), ("div", "center"), ("nav",), ("header", "hgroup"), ("footer", "address"), ("aside",), ("form", "fieldset", "dialog"),
    ("table", "tbody", "tr", "td", "th", "thead", "tfoot"), ("figure", "figcaption"), ("html", "body"), ("details", "summary"),
    ("#text",),
)
#: Kinds of tokens in class, id and role.
TOKEN_KINDS = (
    ("content", "article", "main", "post", "entry", "story", "body", "text", "prose"),
    ("nav", "menu", "breadcrumb", "breadcrumbs", "navbar", "pagination", "pager", "toc", "navigation", "tabs", "skip"),
    ("footer", "foot", "copyright", "legal", "contentinfo", "colophon"),
    ("header", "masthead", "banner", "topbar", "logo", "site"),
    ("sidebar", "aside", "side", "widget", "rail", "related", "recommended", "trending", "more", "complementary", "tags", "popular", "promo"),
    ("ad", "ads", "advert", "adverts", "advertisement", "sponsored", "sponsor", "promoted", "banner"),
    ("comment", "comments", "commentlist", "reply", "replies", "discussion", "disqus", "respond", "reader", "readers", "feedback"),
    ("cookie", "cookies", "notice", "consent", "gdpr", "alert", "modal", "popup", "overlay", "subscribe", "newsletter", "paywall", "announcement"),
    ("share", "social", "byline", "meta", "author", "follow", "print", "login", "signup", "search", "form"),
)
_TOKEN = re.compile(r"[a-z]+")
_KIND_OF = {}
for _k, _words in enumerate(TOKEN_KINDS):
    for _w in _words:
        _KIND_OF.setdefault(_w, []).append(_k)
_GROUP_OF = {tag: k for k, tags in enumerate(TAG_GROUPS) for tag in tags}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END_OR_VALUE = re.compile("[>=]")
_BARE_VALUE = re.compile(r"[^\s>]*")
_BLANKS = re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: The tag of a run of text directly in the body.
RUN = "#text"
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in sorted(RAW)}
_SPACE = re.compile(r"\s+")


class Element:
    """A block element: its own pieces of text and child elements in page order."""

    __slots__ = ("tag", "kinds", "hidden", "parent", "parts", "depth", "chars", "link_chars", "tags", "paragraphs", "children", "commas", "index", "main", "score", "nested")

    def __init__(self, tag: str, parent: Element | None, attributes: str = ""):
        self.tag, self.parent, self.parts, self.hidden, self.main = tag, parent, [], tag in HIDDEN, None
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.link_chars = self.tags = self.paragraphs = self.commas = self.nested = 0
        self.children, self.index, self.kinds = [], 0, ()
        if attributes and not attributes.isspace():
            kinds = set()
            for name, *values in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                # a piece of text's id is where links lead, not what it is
                if name in ("class", "role") or name == "id" and tag not in PIECES:
                    for token in _TOKEN.findall("".join(values).lower()):
                        kinds.update(_KIND_OF.get(token, ()))
                elif hides(name, "".join(values)):
                    self.hidden = True
            self.kinds = tuple(kinds)


def hides(name: str, value: str) -> bool:
    """Whether an attribute takes its element out of the page."""
    return name == "hidden" or name == "style" and "display:none" in value.lower().replace(" ", "")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """A page's pieces of text, start tags and end tags: ("", text, ""), ("<", name, attributes), ("/", name, "").

    Each character is looked at a fixed number of times, whatever is unclosed.
    """
    at, size = 0, len(html)
    last = {q: html.rfind(q) for q in "\"'"}
    while at < size:
        start = html.find("<", at)
        if start < 0:
            yield "", html[at:], ""
            return
        mark = html[start + 1:start + 2]
        if mark == "!" or mark == "?":
            if start > at:
                yield "", html[at:start], ""
            close = "-->" if html.startswith("<!--", start) else "]]>" if html.startswith("<![CDATA[", start) else ">"
            end = html.find(close, start + 2)
            at = end + len(close) if end >= 0 else size
            continue
        name = _NAME.match(html, start + 1 + (mark == "/"))
        if name is None:  # no tag
            if mark == "/":
                if start > at:
                    yield "", html[at:start], ""
                end = html.find(">", start)
                at = end + 1 if end >= 0 else size
            else:
                yield "", html[at:start + 1], ""
                at = start + 1
            continue
        if start > at:
            yield "", html[at:start], ""
        here = name.end()
        while True:
            stop = _END_OR_VALUE.search(html, here)
            if stop is None:
                return
            here = stop.end()
            if stop[0] == ">":
                break
            here = _BLANKS.match(html, here).end()
            quote = html[here:here + 1]
            if quote in last and quote and here < last[quote]:
                here = html.index(quote, here + 1) + 1
            else:
                here = _BARE_VALUE.match(html, here).end()
        at = here
        tag = name[0].lower()
        yield ("/" if mark == "/" else "<"), tag, html[name.end():here - 1]
        if mark != "/" and tag in RAW_ENDS:  # nothing but its end tag ends a raw element
            end = RAW_ENDS[tag].search(html, at)
            at = end.start() if end else size


def parse(html: str) -> Element:
    """The block tree of a page; inline elements only count as tags and links, unless they are hidden."""
    root = Element("html", None)
    here, links = root, 0
    opened = {"html": 1}
    runs: dict[int, Element] = {}

    def open_(tag: str, attributes: str, hidden: bool = False) -> None:
        nonlocal here
        child = Element(tag, here, attributes)
        child.hidden |= here.hidden or hidden
        if not child.hidden:
            runs.pop(id(here), None)
        here.parts.append(child)
        here.children.append(child)
        opened[tag] = opened.get(tag, 0) + 1
        here = child

    def close(stop: Element) -> None:
        nonlocal here, links
        links = 0
        while here is not stop:
            opened[here.tag] -= 1
            here = here.parent

    def end_paragraph() -> None:
        node = here if opened.get("p") else None
        while node is not None and node.tag != "p" and node.tag not in ("td", "th", "body", "article", "div", "section", "li"):
            node = node.parent
        if node is not None and node.tag == "p":
            close(node.parent)

    def text(piece: str) -> None:
        if not piece or here.hidden:
            return
        node = here
        if node.tag in ("html", "body"):  # a run of its own
            node = runs.get(id(here))
            if node is None:
                if piece.isspace():
                    return
                node = runs[id(here)] = Element(RUN, here)
                here.parts.append(node)
                here.children.append(node)
        n = len(piece)
        node.parts.append(piece)
        node.chars += n
        node.commas += piece.count(",")
        if links:
            node.link_chars += n

    for kind, name, attributes in tokens(html):
        if kind == "":
            text(name)
            continue
        if kind == "/":
            if name == "a":
                links = 0
            elif name == "br":
                text(" ")
            elif here.nested and here.tag == name:
                here.nested -= 1
            elif opened.get(name) and not (name == "html" and here.parent is None):
                node = here
                while node.tag != name:
                    node = node.parent
                if node.parent is not None:
                    close(node.parent)
            elif name == "p":
                here.parts.append(None)
                runs.pop(id(here), None)
            continue
        runs.get(id(here), here).tags += 1
        if name in RAW:
            continue
        if name in VOID:
            if name == "br":
                text(" ")
            elif name == "hr":
                end_paragraph()
                here.parts.append(None)
                runs.pop(id(here), None)
            continue
        if name not in BLOCKS and name not in HIDDEN:
            if here.hidden and here.tag == name:
                here.nested += 1
            elif attributes and any(hides(n.lower(), "".join(v)) for n, *v in _ATTRIBUTE.findall(attributes)):
                open_(name, "", True)
            elif name == "a":
                links = 1
            continue
        if name in ("html", "body") and here.parent is None:
            if name == "body":
                open_("body", attributes)
            continue
        if name == "body" and opened.get("head"):
            node = here
            while node.tag != "head":
                node = node.parent
            close(node.parent)
        if name in ENDS_P:
            end_paragraph()
        if name in ENDED_BY:
            ended, stop = ENDED_BY[name]
            node, last, left = here, None, sum(opened.get(t, 0) for t in ended)
            while left and node is not None and node.tag not in stop:
                if node.tag in ended:
                    last = node
                    left -= 1
                node = node.parent
            if last is not None:
                close(last.parent)
        links = 0
        open_(name, attributes)
    return root


def elements(root: Element) -> list[Element]:
    """All elements, parents first, with the numbers of their subtrees added up."""
    order = [root]
    for node in order:
        for k, child in enumerate(node.children):
            child.index = k
        order.extend(c for c in node.children if not c.hidden)
    for node in reversed(order):
        if node.tag in ("p", "pre", "blockquote", RUN):
            node.paragraphs += node.chars > 60
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags
            up.paragraphs += node.paragraphs
            up.commas += node.commas
    return order


N_TAGS, N_KINDS = len(TAG_GROUPS), len(TOKEN_KINDS)
WIDTH = N_TAGS * 2 + N_KINDS * 3 + 15


def features(order: list[Element]) -> np.ndarray:
    """One row of features per element."""
    out = np.zeros((len(order), WIDTH), np.float32)
    whole = max(1, order[0].chars)
    place = {id(n): k for k, n in enumerate(order)}
    for k, n in enumerate(order):
        row, up = out[k], n.parent
        if (g := _GROUP_OF.get(n.tag)) is not None:
            row[g] = 1
        for kind in n.kinds:
            row[2 * N_TAGS + kind] = 1
        if up is not None:
            if (g := _GROUP_OF.get(up.tag)) is not None:
                row[N_TAGS + g] = 1
            for kind in up.kinds:
                row[2 * N_TAGS + N_KINDS + kind] = 1
            above = out[place[id(up)], 2 * N_TAGS:2 * N_TAGS + 3 * N_KINDS].reshape(3, N_KINDS)
            row[2 * N_TAGS + 2 * N_KINDS:2 * N_TAGS + 3 * N_KINDS] = np.maximum(above[0], above[2])
            siblings, around = len(up.children), max(1, up.chars)
        else:
            siblings, around = 1, whole
        chars = max(1, n.chars)
        row[-15:] = (
            n.depth, np.log1p(n.chars), n.link_chars / chars, np.log1p(n.tags), n.tags / chars, n.paragraphs, n.commas / chars, len(n.children), siblings,
            n.index / max(1, siblings), n.chars / around, n.chars / whole, n.paragraphs / max(1, order[0].paragraphs), up.link_chars / around if up else 0, siblings - n.index,
        )
    return out


class BoostedTrees:
    """Gradient-boosted regression trees for a yes/no label, with logistic loss."""

    def __init__(self, edges: list[np.ndarray], trees: list[list[tuple]], base: float):
        self.edges, self.trees, self.base = edges, trees, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> BoostedTrees:
        """Histogram trees grown level by level to ``depth``; second-order gain."""
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        share = y.mean().clip(1e-3, 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        raw, trees = np.full(len(y), base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            gradient, hessian = y - p, p * (1 - p)
            tree, node = [], np.zeros(len(y), np.int64)
            for level in range(depth + 1):
                for own in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == own)
                    g, h = gradient[rows].sum(), hessian[rows].sum()
                    leaf = rate * g / (h + 1)
                    split = None
                    if level < depth and len(rows) > 8:
                        top = 1e-3
                        for f in range(x.shape[1]):
                            if len(edges[f]):
                                b = binned[rows, f]
                                left_g = np.cumsum(np.bincount(b, gradient[rows], BINS + 1))[:len(edges[f])]
                                left_h = np.cumsum(np.bincount(b, hessian[rows], BINS + 1))[:len(edges[f])]
                                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g * g / (h + 1)
                                k = int(np.argmax(gain))
                                if gain[k] > top:
                                    top, split = gain[k], (f, k)
                    tree.append((split, leaf))
                    if split:
                        node[rows] = 2 * own + 1 + (binned[rows, split[0]] > split[1])
                    else:
                        raw[rows] += leaf
            trees.append(tree)
        return cls(edges, trees, base)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows."""
        out = np.full(len(x), self.base)
        for tree in self.trees:
            node, active = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(active):
                for own in np.unique(node[active]):
                    rows = active[node[active] == own]
                    split, leaf = tree[own]
                    if split is None:
                        out[rows] += leaf
                        node[rows] = -1
                    else:
                        f, k = split
                        node[rows] = 2 * own + 1 + (x[rows, f] > self.edges[f][k])
                active = active[node[active] >= 0]
        return out


def decode(order: list[Element], raw: np.ndarray) -> None:
    """Sets ``main`` from the root down, so that no element contradicts its ancestors.

    0: outside, with its subtree; 1: undecided frame; 2: inside.
    """
    for node, score in zip(order, raw):
        node.score = score
        up = node.parent.main if node.parent is not None else 1
        if up == 0:
            node.main = 0
        elif node.parent is None or node.tag in ("html", "body"):
            node.main = 1
        elif up == 2:
            node.main = 2 if score > CONFIDENT else 0
        else:
            node.main = 2 if score > 0 else 0


def blocks(root: Element) -> list[str]:
    """Texts of the kept blocks in page order."""
    out, run = [], []

    def flush() -> None:
        if run:
            piece = _SPACE.sub(" ", unescape("".join(run))).strip()
            if piece:
                out.append(piece)
            run.clear()

    stack = [(root, iter(root.parts))]
    while stack:
        node, parts = stack[-1]
        for part in parts:
            if part.__class__ is str:
                if node.main == 2:
                    run.append(part)
            else:
                if part is not None and part.hidden:
                    continue
                flush()
                if part is not None and part.main:
                    stack.append((part, iter(part.parts)))
                    break
        else:
            flush()
            stack.pop()
    return out


_WORDS = "ta re lo min sa ver con del pro ist ung und ent aux eau que ras cion mente the and ing tion er on an".split()


def _sentence(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choices(_WORDS, k=r.randint(1, 3))) for _ in range(r.randint(low, high))]
    marks = r.choice(("", "", "", "&amp;", "***", " &copy;"))
    return ", ".join(" ".join(words[k:k + 9]) for k in range(0, len(words), 9)).capitalize() + "." + marks


def training_page(r: random.Random) -> str:
    """A page whose elements carry their label in the attribute ``y`` (1 inside, 0 outside)."""
    link = lambda: f'<a href="/{r.randint(1, 999)}">{_sentence(r, 1, 4)[:-1]}</a>'
    name = lambda *names: r.choice(("", f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} x{r.randint(1, 9)}"'))
    named = lambda *names: f' {r.choice(("class", "id", "class"))}="{r.choice(names)}"'

    def listed(n: int, y: int = 0) -> str:
        items = "".join(f"<li y={y}>{link()}" + r.choice(("</li>", "</li>", "")) for _ in range(n))
        return f"<ul y={y}>{items}</ul>"

    def menu() -> str:
        return r.choice((
            lambda: f"<nav{name('nav', 'menu')} y=0>{listed(r.randint(3, 9))}</nav>", lambda: f"<div{named('menu', 'navbar', 'nav-main', 'breadcrumbs')} y=0>{listed(r.randint(3, 9))}</div>",
            lambda: f"<div{named('breadcrumb', 'pagination')} y=0>{' &raquo; '.join(link() for _ in range(3))}</div>", lambda: f"<nav y=0>{' | '.join(link() for _ in range(r.randint(3, 8)))}</nav>",
            lambda: f"<ul{named('menu', 'nav')} y=0>{''.join(f'<li y=0>{link()}</li>' for _ in range(5))}</ul>",
        ))()

    def header() -> str:
        return r.choice((
            lambda: f"<header{name('site-header', 'masthead')} y=0>{r.choice(('', link() + ' '))}{_sentence(r, 1, 6)}</header>",
            lambda: f"<header y=0>{_sentence(r, 1, 3)[:-1]}</header>",
            lambda: f"<header{name('site-header', 'masthead')} y=0><div y=0>{_sentence(r, 1, 5)}</div>{menu() if r.random() < 0.5 else ''}</header>",
            lambda: f"<div{named('header', 'topbar', 'masthead', 'banner')} y=0>{r.choice(('<h1 y=0>{}</h1>', '<p y=0>{}</p>', '{}')).format(_sentence(r, 1, 5))}</div>",
        ))()

    def footer() -> str:
        body = r.choice((lambda: f"&copy; 20{r.randint(10, 30)} {_sentence(r, 2, 12)}", lambda: f"<p y=0>&copy; {_sentence(r, 3, 20)}</p>{listed(3)}", lambda: f"<p y=0>{link()} &middot; {link()}</p>"))()
        return r.choice((f"<footer{name('footer')} y=0>{body}</footer>", f"<div{named('footer', 'copyright', 'legal', 'site-footer')} y=0>{body}</div>"))

    def sidebar() -> str:
        body = r.choice((lambda: f"<h3 y=0>{_sentence(r, 1, 4)}</h3>{listed(r.randint(2, 7))}", lambda: f"<p y=0>{_sentence(r, 5, 40)}</p>", lambda: f"<h4 y=0>{_sentence(r, 1, 4)}</h4><p y=0>{_sentence(r, 8, 30)}</p><p y=0>{link()}</p>"))()
        return r.choice((f"<aside{name('sidebar', 'related')} y=0>{body}</aside>", f"<div{named('sidebar', 'widget', 'related', 'recommended', 'rail', 'trending')} y=0>{body}</div>", f"<section{named('related', 'more', 'sidebar')} y=0>{body}</section>"))

    def advert() -> str:
        body = r.choice((lambda: _sentence(r, 3, 25), lambda: f"<p y=0>{_sentence(r, 3, 25)}</p>", lambda: f"{link()}"))()
        return r.choice((f"<div{named('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'promoted')} y=0>{body}</div>", f"<aside{named('ad', 'advertisement')} y=0>{body}</aside>", f"<section{named('sponsored')} y=0>{body}</section>", f"<p{named('ad', 'advert', 'sponsored')} y=0>{_sentence(r, 3, 25)}</p>"))

    def notice() -> str:
        body = r.choice((f"<p y=0>{_sentence(r, 5, 30)}</p>", _sentence(r, 5, 30), f"<p y=0>{_sentence(r, 5, 20)}</p>{link()}<button>{_sentence(r, 1, 2)}</button>"))
        return r.choice((f"<div{named('cookie-banner', 'notice', 'consent', 'gdpr', 'alert', 'modal', 'popup', 'newsletter', 'subscribe', 'announcement')} y=0>{body}</div>", f"<dialog y=0>{body}</dialog>", f'<div role="alert" y=0>{body}</div>', f"<section{named('notice', 'cookies')} y=0>{body}</section>", f"<p{named('notice', 'cookie-notice')} y=0>{_sentence(r, 5, 30)}</p>"))

    def form() -> str:
        return f"<form{name('search', 'login', 'subscribe')} y=0><label>{_sentence(r, 1, 6)}</label><input name=q>{r.choice((f'<p y=0>{_sentence(r, 3, 15)}</p>', f'<div y=0>{_sentence(r, 3, 15)}</div>', ''))}<button>{_sentence(r, 1, 2)}</button></form>"

    def comments() -> str:
        one = lambda: r.choice((f"<div{named('comment', 'reply')} y=0><p y=0>{_sentence(r, 4, 60)}</p></div>", f"<article{named('comment')} y=0><p y=0>{_sentence(r, 4, 60)}</p></article>", f"<li{named('comment')} y=0><p y=0>{_sentence(r, 4, 60)}</p></li>", f"<p y=0>{_sentence(r, 4, 60)}</p>"))
        body = f"<{(h := r.choice(('h2', 'h3')))} y=0>{_sentence(r, 1, 3)}</{h}>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 6)))
        return r.choice((f"<section{named('comments', 'discussion', 'reader-comments')} y=0>{body}</section>", f"<div{named('comments', 'respond', 'replies', 'comment-list')} y=0>{body}</div>", f"<ol{named('comments', 'comment-list')} y=0>{body}</ol>"))

    paragraph = lambda: r.choice((lambda: f"<p y=1>{_sentence(r, 4, 120)}</p>", lambda: f"<p y=1>{_sentence(r, 8, 90)}", lambda: f"<p y=1><b>{_sentence(r, 2, 12)}<br>", lambda: f"<p y=1>{_sentence(r, 8, 60)} {link()} {_sentence(r, 4, 20)}</p>"))()
    inner = lambda: r.choices((
        paragraph, lambda: f"<{(h := r.choice(('h2', 'h3', 'h4')))} y=1>{_sentence(r, 1, 9)}</{h}>", lambda: f"<{(h := r.choice(('ul', 'ol')))} y=1>{''.join(f'<li y=1>{_sentence(r, 2, 25)}</li>' for _ in range(r.randint(2, 6)))}</{h}>",
        lambda: f"<blockquote y=1><p y=1>{_sentence(r, 5, 40)}</p></blockquote>", lambda: f"<table y=1><tr y=1><td y=1>{_sentence(r, 1, 8)}</td><td y=1>{_sentence(r, 1, 8)}</td></tr></table>", lambda: f"<pre y=1>{_sentence(r, 4, 30)}</pre>",
        lambda: f"<figure y=1><img src=x><figcaption y=1>{_sentence(r, 3, 20)}</figcaption></figure>", lambda: f"<div y=1>{_sentence(r, 8, 80)}</div>", lambda: f"<section y=1><h2 y=1>{_sentence(r, 1, 7)}</h2>{paragraph()}{paragraph()}</section>",
        advert, sidebar, notice, form, lambda: f"<div{named('share', 'social')} y=0>{link()} {link()}</div>",
    ), weights=(24, 3, 2, 1, 1, 1, 1, 2, 2, 1, 0.7, 0.7, 0.4, 0.7))[0]()
    some = lambda p, f: f() if r.random() < p else ""
    bare = lambda y: chr(0xE000 + y) + r.choice((_sentence(r, 1, 60), f"{_sentence(r, 1, 30)}<br><br>{_sentence(r, 2, 40)}", f"<b>{_sentence(r, 1, 5)}</b> {_sentence(r, 2, 30)}"))
    # how much stands around the article: from nothing to everything
    around = r.choice((0, 0.2, 0.4, 1, 1, 1))
    title = some(0.75, lambda: f"<h1 y=1>{_sentence(r, 1, 12)}</h1>")
    if (kind := r.random()) < 0.5:
        body = title + "".join(inner() for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))))
    elif kind < 0.8:  # short or plain articles
        body = title * r.randint(0, 1) + "".join(r.choice(("<p y=1>{}</p>", "<p y=1>{}</p>", "<p y=1><b>{}<br>", "<p y=1>{}")).format(_sentence(r, 1, r.choice((1, 3, 8, 20, 70)))) for _ in range(r.choice((1, 1, 1, 2, 3))))
    else:
        body = None
    headed = bool(body and title and body.startswith(title) and r.random() < 0.12)
    if headed:
        body = f"<header y=1>{title}</header>" + body.removeprefix(title)
    if body and r.random() < 0.15 * around:
        body += f"<footer{name('meta', 'post-footer')} y=0>{r.choice(('<p y=0>{}</p>', '{}')).format(_sentence(r, 2, 15))}</footer>"
    if body and r.random() < 0.2 * around:
        body += comments()
    if body is None:  # one element, or the page itself, holds the text
        body = r.choice((
            lambda: f"<div y=1>{_sentence(r, 3, 90)}</div>", lambda: f"<article{name('post')} y=1>{_sentence(r, 2, 60)}</article>", lambda: f"<main y=1>{_sentence(r, 2, 60)}</main>",
            lambda: f"<div{named('content', 'post', 'text')} y=1>{_sentence(r, 3, 60)}<br>{_sentence(r, 3, 60)}</div>", lambda: f"{title}{bare(1)}<p y=1>{_sentence(r, 1, 40)}</p>",
            lambda: f"{title}<p y=1>{_sentence(r, 1, 40)}</p>{bare(1)}", lambda: f"{title}{bare(1)}", lambda: "".join(f"<p y=1>{_sentence(r, 1, 60)}</p>" for _ in range(r.choice((1, 1, 2, 5)))),
            lambda: "".join(f"<div y=1>{_sentence(r, 2, 60)}</div>" for _ in range(r.choice((1, 2, 5)))), lambda: f"<table y=1><tr y=1><td y=1>{title}<p y=1>{_sentence(r, 5, 90)}</p></td></tr></table>",
        ))()
    else:
        body = r.choices((
            f"<article{name('post', 'entry', 'story')} y=1>{body}</article>", f"<main y=1>{body}</main>", f"<main y=1><article y=1>{body}</article></main>", f"<div{named('content', 'article-body', 'post', 'entry-content', 'main', 'story')} y=1>{body}</div>",
            f"<section{named('content', 'article', 'main-text')} y=1>{body}</section>", f'<div role="main" y=1>{body}</div>', f"<div y=1>{body}</div>", body,
        ), weights=(8, 2, 2, 4, 1, 1, 1, 0 if headed else 1.5))[0]
        if r.random() < 0.3 * around:
            body = f"<div{named('wrapper', 'container', 'page', 'row')} y=1>{r.choice((sidebar, advert, menu, lambda: ''))()}{body}{r.choice((sidebar, advert, comments, lambda: ''))()}</div>"
        elif r.random() < 0.1:
            body = f"<div y=1><div y=1>{body}</div></div>"
    lead = [some(p * around, f) for p, f in ((0.6, header), (0.8, menu), (0.25, notice), (0.5, advert), (0.2, form), (0.2, sidebar))]
    tail = [some(p * around, f) for p, f in ((0.4, sidebar), (0.3, comments), (0.25, advert), (0.25, notice), (0.2, form), (0.2, menu))]
    r.shuffle(tail)
    if r.random() < 0.04:  # a page without an article
        body = r.choice((menu, lambda: listed(4), footer, notice))()
    if tail[-1] == "" and not body.endswith(("</div>", "</article>", "</section>", "</main>", "</p>", "</table>")):
        tail[-1] = "<hr>"
    end = some(0.85 * around, footer) or some(0.1 * around, lambda: f"<hr>{chr(0xE000)}&copy; 20{r.randint(10, 30)} {_sentence(r, 1, 8)}")
    inside = "".join(lead) + body + "".join(tail) + end
    return r.choices((f"<!DOCTYPE html><html><head><title>{_sentence(r, 2, 8)}</title></head><body>{inside}</body></html>", f"<html><body>{inside}</body></html>", inside), weights=(8, 1, 1.5))[0]


def labelled(page: str) -> tuple[list[Element], np.ndarray]:
    """A training page's elements and their labels; -1 for frames, which have none."""
    order = elements(parse(re.sub(" y=\\d|[\ue000\ue001]", "", page)))
    # the marks stand in the page in the order of their elements
    marks = [a or str(ord(b) - 0xE000) for a, b in re.findall("<[a-z0-9]+(?: [^>]*?)? y=(\\d)|([\ue000\ue001])", page)]
    document = [n for n in _in_page_order(order[0]) if n.tag not in ("html", "body") and not n.hidden]
    if len(document) != len(marks):
        raise ValueError(f"{len(document)} elements, {len(marks)} marks: {page}")
    label = {id(n): int(m) for n, m in zip(document, marks)}
    return order, np.array([label.get(id(n), -1) for n in order])


@lru_cache(maxsize=1)
def model() -> BoostedTrees:
    """The trained trees; the same in every process."""
    r, rows, labels = random.Random(SEED), [], []
    for _ in range(TRAINING_PAGES):
        order, label = labelled(training_page(r))
        rows.append(features(order)[label >= 0])
        labels.append(label[label >= 0])
    return BoostedTrees.fit(np.concatenate(rows), np.concatenate(labels).astype(float))


def _in_page_order(root: Element) -> list[Element]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def extract_texts(pages: list[str | None], trees: BoostedTrees) -> list[str]:
    """Main texts of pages; the trees judge all elements of the pages at once."""
    orders = [elements(parse(p)) if p else [] for p in pages]
    rows = [features(o) for o in orders if o]
    raw = trees.raw(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for order in orders:
        if order:
            decode(order, raw[at:at + len(order)])
            at += len(order)
        kept = blocks(order[0]) if order else []
        out.append("\n\n".join(kept))
    return out


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Adds ``text_col``, the main text of ``html_col``, to all rows and columns."""
    shared = pages.sparkSession.sparkContext.broadcast(model())

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            values = html.tolist()
            texts = [t for k in range(0, len(values), 64) for t in extract_texts(values[k:k + 64], shared.value)]
            yield pd.Series(texts, dtype=object)

    return pages.withColumn(text_col, main_text(F.col(html_col)))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
