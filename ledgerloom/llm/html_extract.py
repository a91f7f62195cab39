"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

A page is parsed to its block elements (inline markup counts to the block around
it). Each block has features of its subtree (text, link and punctuation density,
blocks below), its tag, the words of its attributes, its depth and its siblings.
Boosted trees, learned here from pages composed by rule in many layouts, give each
block the log-odds of being article. Decoding picks a state for every block (outside,
article, or dropped inside an article) by a dynamic program over the tree: below
an article there is only article or dropped, below dropped only dropped; so no
block contradicts what stands above it.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact_ids, ids, table

# HTML's own element lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Blocks that text doesn't stand in by itself (the first is the page).
BARE = frozenset(["#", "html", "body"])
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Groups of tags and of attribute words, each a feature.
TAGS = ["p", "h1 h2", "h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "header", "footer", "aside", "article", "main", "section", "form fieldset button label", "table tbody thead tr td th", "blockquote pre", "figure figcaption", "div center", "body html"]
WORDS = [
    "article content post entry story main text body blog news",
    "nav menu breadcrumb breadcrumbs toc pagination pager tabs navigation navbar",
    "header masthead banner hero topbar logo head",
    "footer copyright legal colophon bottom foot",
    "sidebar side aside widget related recommended more trending popular rail also",
    "ad ads advert advertisement sponsor sponsored promo promotion promoted dfp",
    "comment comments reply replies discussion disqus respond reader readers",
    "share social follow newsletter subscribe subscription signup login search form",
    "cookie cookies consent notice gdpr privacy alert modal popup overlay disclaimer paywall",
    "author byline meta tags date info caption",
]
_TAG = {t: i for i, group in enumerate(TAGS) for t in group.split()}
_WORD = {w: i for i, group in enumerate(WORDS) for w in group.split()}
#: Features that a block hands on to all below it: tags that hold no article or are one, and attribute words.
HANDED = [*(TAGS.index(t) for t in ("nav", "header", "footer", "aside", "article", "main", "form fieldset button label")), *range(len(TAGS), len(TAGS) + len(WORDS))]
N_FEATURES = len(TAGS) + len(WORDS) + 14 + len(HANDED)

# A quote opens a value only right after the equals sign; anywhere else it is a character like any other.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_LETTERS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Page:
    """Blocks in page order, and the text pieces with the block each belongs to."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attrs, self.depths = ["#"], [-1], [""], [0]
        self.own, self.linked, self.stops = [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]  # open elements, each with its block
        # Places in the stack: of open elements by name, and of those that are blocks; so that nothing searches the stack.
        opened: dict[str, list[int]] = defaultdict(list)
        blocks = [0]
        at, links, loose = 0, 0, 0
        find = _TOKEN.search

        def put(name: str, block: int) -> None:
            opened[name].append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append((name, block))

        def cut(k: int) -> int:
            """Closes what is open from place ``k`` on; gives the number of links among it."""
            gone = 0
            while len(stack) > k:
                name, _ = stack.pop()
                opened[name].pop()
                if blocks[-1] == len(stack):
                    blocks.pop()
                gone += name == "a"
            return gone

        while True:
            m = find(source, at)
            text = source[at : m.start()] if m else source[at:]
            if text:
                inside = stack[-1][1]
                if self.tags[inside] in BARE and not text.isspace():
                    # Text in no block, or straight in a body, is in a paragraph of its own, up to the next block.
                    if not loose or self.parents[loose] != inside:
                        loose = self._block("p", inside, "")
                    inside = loose
                self._text(inside, text, links)
            if not m:
                return
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name not in VOID and opened[name]:
                    k = opened[name][-1]
                    if stack[k][1] != stack[k - 1][1]:
                        self.pieces.append((stack[k][1], " "))
                    links -= cut(k)
                continue
            if name in VOID:
                if name == "br" or name == "hr":
                    self.pieces.append((stack[-1][1], " "))
                continue
            if name in RAW:
                if not m[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            if name in INLINE:
                put(name, stack[-1][1])
                links += name == "a"
                continue
            # A block ends an open paragraph that it stands in, and by its name open items of its list or cells of its row.
            if closing := CLOSED_BY.get(name):
                scope = max((opened[t][-1] for t in SCOPES[name] if opened[t]), default=0)
                ends = [own[i] for t in ("p", *closing) if (own := opened[t]) and (i := bisect_right(own, scope)) < len(own)]
                if ends:
                    links -= cut(min(ends))
            elif stack[blocks[-1]][0] == "p":
                links -= cut(blocks[-1])
            block, loose = self._block(name, stack[-1][1], m[3]), 0
            put(name, block)

    def _block(self, name: str, parent: int, attrs: str) -> int:
        block = len(self.tags)
        self.tags.append(name)
        self.parents.append(parent)
        self.attrs.append(attrs)
        self.depths.append(self.depths[parent] + 1)
        self.own.append(0)
        self.linked.append(0)
        self.stops.append(0)
        self.pieces.append((block, " "))
        return block

    def _text(self, block: int, text: str, links: int) -> None:
        self.pieces.append((block, text))
        n = len(text) - text.count(" ") if len(text) < 200 else len(text) * 5 // 6
        if not text.isspace():
            self.own[block] += n
            self.stops[block] += text.count(".") + text.count(",")
            if links > 0:
                self.linked[block] += n

    def text(self, keep: list[bool]) -> str:
        """The text of the blocks kept, white space turned into single blanks."""
        parts, last = [], -1
        for block, piece in self.pieces:
            if keep[block]:
                if block != last and last >= 0:
                    parts.append(" ")
                parts.append(piece)
                last = block
            elif piece == " ":
                parts.append(" ")
        joined = "".join(parts)
        return " ".join((html.unescape(joined) if "&" in joined else joined).split())


def _attr_words(attrs: str, known: dict[str, np.ndarray]) -> np.ndarray:
    if attrs not in known:
        row = np.zeros(len(WORDS), np.float32)
        for value in _ATTR.findall(attrs):
            for w in _LETTERS.findall(value):
                if (i := _WORD.get(w.lower())) is not None:
                    row[i] += 1
        if len(known) > 10_000:
            known.clear()
        known[attrs] = row
    return known[attrs]


def features(page: Page, known: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each block."""
    n = len(page.tags)
    parents = page.parents
    text, linked, stops, below, depth_below, paragraphs = list(page.own), list(page.linked), list(page.stops), [0] * n, [0] * n, [int(t == "p") for t in page.tags]
    children = [0] * n
    place, same = [0] * n, [0] * n
    seen: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parents[i]
        place[i] = children[p]
        children[p] += 1
        seen[p, page.tags[i]] = seen.get((p, page.tags[i]), 0) + 1
    for i in range(n - 1, 0, -1):
        p = parents[i]
        text[p] += text[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        below[p] += below[i] + 1
        paragraphs[p] += paragraphs[i]
        depth_below[p] = max(depth_below[p], depth_below[i] + 1)
        same[i] = seen[p, page.tags[i]]
    x = np.zeros((n, N_FEATURES), np.float32)
    for i in range(n):
        k = _TAG.get(page.tags[i])
        if k is not None:
            x[i, k] = 1
        if page.attrs[i]:
            x[i, len(TAGS) : len(TAGS) + len(WORDS)] = _attr_words(page.attrs[i], known)
    t, up = np.array(text, np.float32), np.array([max(p, 0) for p in parents])
    own, b, kids = np.array(page.own, np.float32), np.array(below, np.float32), np.array(children, np.float32)
    c = len(TAGS) + len(WORDS)
    x[:, c] = np.log1p(t)
    x[:, c + 1] = np.array(linked, np.float32) / np.maximum(t, 1)
    x[:, c + 2] = t / (1 + b)
    x[:, c + 3] = np.array(stops, np.float32) / np.maximum(t, 1) * 100
    x[:, c + 4] = own / np.maximum(t, 1)
    x[:, c + 5] = page.depths
    x[:, c + 6] = depth_below
    x[:, c + 7] = t / max(text[0], 1)
    x[:, c + 8] = t / np.maximum(t[up], 1)
    x[:, c + 9] = np.array(place, np.float32) / np.maximum(kids[up], 1)
    x[:, c + 10] = same
    x[:, c + 11] = kids
    x[:, c + 12] = np.array(paragraphs, np.float32) / (1 + b)
    x[:, c + 13] = x[up, c + 1]
    handed, above = x[:, HANDED], np.zeros((n, len(HANDED)), np.float32)
    for i in range(1, n):
        above[i] = above[parents[i]] + handed[parents[i]]
    x[:, c + 14 :] = above
    return x


class Boosted:
    """Regression trees of fixed depth on the logistic loss, split at histogram bounds."""

    def __init__(self, depth: int = 4, trees: int = 50, rate: float = 0.2, bins: int = 32):
        self.depth, self.trees, self.rate, self.bins = depth, trees, rate, bins
        self.made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature and bound per inner node, value per leaf
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        n, m = x.shape
        bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)], axis=1)
        rate = np.average(y, weights=weight)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            node = np.zeros(n, np.int64)
            feature, bound = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf, np.float32)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-3)
                for j in range(m):
                    k = len(bounds[j])
                    if not k:
                        continue
                    cell = node * (k + 1) + binned[:, j]
                    sg = np.bincount(cell, g, width * (k + 1)).reshape(width, k + 1).cumsum(axis=1)
                    sh = np.bincount(cell, h, width * (k + 1)).reshape(width, k + 1).cumsum(axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    top = gain[:, :-1].argmax(axis=1)
                    value = gain[np.arange(width), top]
                    better = value > best
                    best = np.where(better, value, best)
                    feature[first : first + width][better] = j
                    bound[first : first + width][better] = bounds[j][top[better]]
                node = node * 2 + (x[np.arange(n), feature[first + node]] > bound[first + node])
            leaves = 2**self.depth
            leaf = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            self.made.append((feature, bound, leaf))
            score += leaf[node]
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        rows, out = np.arange(len(x)), np.full(len(x), self.start)
        for feature, bound, leaf in self.made:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + 2**level - 1
                node = node * 2 + (x[rows, feature[at]] > bound[at])
            out += leaf[node]
        return out


#: What it costs to begin an article, and to drop a block inside one (nothing: the trees have learned from such blocks).
BEGIN, DROP = 1.0, 0.0


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which blocks are article, by the best consistent states of all blocks (0 outside, 1 article, 2 dropped)."""
    n, odds = len(page.tags), np.clip(odds, -8, 8).tolist()
    below = [[0.0, 0.0, 0.0] for _ in range(n)]
    choice: list[tuple[int, int]] = [(0, 1)] * n
    for i in range(n - 1, -1, -1):
        s = odds[i]
        out, own, drop = below[i][0] - s, below[i][1] + s, below[i][2] - s
        under_out, under_own = (0, 1)[own - BEGIN > out], (2, 1)[own >= drop - DROP]
        choice[i] = (under_out, under_own)
        if i:
            p = below[page.parents[i]]
            p[0] += max(out, own - BEGIN)
            p[1] += max(own, drop - DROP)
            p[2] += drop
    states = [0] * n
    for i in range(1, n):
        up = states[page.parents[i]]
        states[i] = 2 if up == 2 else choice[i][up]
    return [s == 1 for s in states]


# --- pages to learn from ---------------------------------------------------


def _compose(rng: random.Random, inside: float = 0.1) -> str:
    """A page in a random layout; blocks that are article carry the attribute ``y``. ``inside``: the share of pages whose article has boxes of other things among its blocks."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    style = rng.random()  # of a page: mostly sentences, some without punctuation, some one word again and again, some of signs

    def prose(a: int = 1, b: int = 6) -> str:
        if style < 0.7:
            return " ".join(words(4, 18).capitalize() + rng.choice(".,.") for _ in range(rng.randint(a, b)))
        if style < 0.8:
            return words(2, 30 * b)
        if style < 0.9:
            return " ".join([word()] * rng.randint(3, 30 * b))
        return " ".join(word() + rng.choice(["###", "&amp;&amp;", "!!", " |", "$$$"]) for _ in range(rng.randint(4, 20 * b)))

    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    maybe = lambda s, p=0.5: s if rng.random() < p else ""
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"

    def boxed(name: str, kind: str) -> str:
        """A box that names itself by one of the words of group ``kind``, of any shape."""
        own = rng.choice([prose(1, 1), prose(1, 2), f"<p>{prose(1, 2)}</p>", f"<p>{prose(1, 1)}</p><p>{prose(1, 2)}</p>", words(2, 12), f"<h3>{words(1, 4)}</h3><p>{prose(1, 2)}</p>", f"<h3>{words(1, 3)}</h3>{links()}", f"{link()} {link()}", f"<p>{prose(1, 1)} {link()}</p>", f"<div><p>{prose(1, 3)}</p></div>", f"{words(2, 8)} <button>{word()}</button>"])
        return f'<{name} {rng.choice(["class", "class", "id"])}="{maybe(word() + " ", 0.15)}{rng.choice(WORDS[int(kind)].split())}{maybe(rng.choice(["-box", " box", "-1", "_inner", "-wrapper"]), 0.4)}">{own}</{name}>'

    def noise(inside: bool = False) -> str:
        if rng.random() < (0.75 if inside else 0.35):
            return boxed(rng.choice(["div", "div", "div", "aside", "section", "p" if inside and rng.random() < 0.2 else "div"]), rng.choice("11145555666777888"))
        kind = rng.randrange(9)
        if kind == 0:
            return f'<div class="{rng.choice(["ad", "ads", "advert banner", "sponsored", "promo-box", "ad-slot"])}">{rng.choice([prose(1, 2), link(), words(3, 12)])}</div>'
        if kind == 1:
            return f'<{(t := rng.choice(["aside", "div"]))} class="{rng.choice(["related", "sidebar", "widget", "more-news", "rail"])}"><h3>{words(1, 4)}</h3>{links()}{maybe(f"<p>{prose(1, 2)}</p>")}</{t}>'
        if kind == 2:
            return f'<div class="{rng.choice(["share", "social", "newsletter", "subscribe"])}">{link()} {link()}{maybe("<p>" + prose(1, 1) + "</p>")}</div>'
        if kind == 3:
            return f"<form action='/s'><label>{words(1, 3)}</label><input name=q><button>{word()}</button>{maybe('<p>' + prose(1, 1) + '</p>')}</form>"
        if kind == 4:
            return f'<aside{maybe(" class=note")}><p>{prose(1, 2)}</p></aside>'
        if kind == 5:
            return f'<div {rng.choice(["class", "id"])}="{rng.choice(["cookie-notice", "cookies", "consent", "notice", "gdpr", "disclaimer", "alert"])}"><p>{prose(1, 3)}</p>{maybe("<button>" + word() + "</button>")}</div>'
        if kind == 6:
            own = "".join(f'<{(t := rng.choice(["div", "li", "article"]))} class="comment{maybe("-body")}"><p>{prose(1, 4)}</p></{t}>' for _ in range(rng.randint(1, 5)))
            return f'<{(t := rng.choice(["section", "div"]))} {rng.choice(["id", "class"])}="{rng.choice(["comments", "discussion", "reader-comments", "replies"])}"><h3>{words(1, 3)}</h3>{own}</{t}>'
        if kind == 7:
            return f'<{(t := rng.choice(["nav", "div class=menu", "div id=nav", "div class=breadcrumbs", "nav"]))}>{rng.choice([links(), link() + " " + link()])}</{t.split()[0]}>'
        return f'<div class="{rng.choice(["sidebar", "side", "widget"])}">{"".join(f"<p>{prose(1, 2)}</p>" for _ in range(rng.randint(1, 3)))}</div>'

    def content() -> str:
        out, mixed = maybe(f"<h1 y>{rng.choice([words(1, 10), prose(1, 1)])}</h1>", 0.8), rng.random() < inside
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            if mixed and rng.random() < 0.4:  # what is no article stands among its blocks
                out += noise(True)
            kind = rng.randrange(14)
            if kind <= 6:
                own = rng.choice(["lead", "text", "paragraph", "intro", "body-text", "dropcap", "summary", word()])
                out += f"<p{maybe(f' class={own}', 0.1)} y>{maybe('<b>' + words(1, 4) + '</b> ', 0.2)}{prose()}{maybe(' ' + link() + '.', 0.2)}{maybe('<br>' + prose(1, 2), 0.2)}" + maybe("</p>", 0.85)
            elif kind == 7:
                out += f"<h2 y>{words(2, 6)}</h2><p y>{prose()}</p>"
            elif kind == 8:
                out += "<ul y>" + "".join(f"<li y>{words(3, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            elif kind == 9:
                out += f"<blockquote y><p y>{prose(1, 2)}</p></blockquote>"
            elif kind == 10:
                out += f"<div y><p y>{prose()}</p></div>" if rng.random() < 0.4 else f"<p y>{words(1, 6)}.</p>"
            elif kind == 11:  # a box of the article, under a name that says nothing about it
                own = rng.choice([word(), word(), "lead", "text", "body", "row", "col", "quote", "section", "part-" + word(), "intro", "highlight"])
                inner = rng.choice([lambda: prose(1, 2), lambda: f"<p y>{prose(1, 2)}</p>", lambda: f"<p y>{prose(1, 2)}</p><p y>{prose(1, 1)}</p>", lambda: f"<h3 y>{words(1, 4)}</h3><p y>{prose(1, 2)}</p>"])()
                out += f'<{(t := rng.choice(["div", "div", "section"]))}{maybe(f""" {rng.choice(["class", "id"])}="{own}" """, 0.85)} y>{inner}</{t}>'
            else:
                out += "<table y>" + "".join(f"<tr y><td y>{words(1, 3)}</td><td y>{words(1, 5)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        return out

    if rng.random() < 0.12:  # no box at all: text alone, in the body or in nothing, perhaps below a menu
        own = rng.choice(["".join(f"<p y>{prose()}{maybe(' ' + link() + '.', 0.2)}</p>" for _ in range(rng.randint(1, 4))), f"<p y>{rng.choice([prose(), words(1, 8)])}{maybe('<br>' + prose())}</p>"])
        menu = maybe(f"<nav>{rng.choice([links(), link() + ' ' + link()])}</nav>", 0.5)
        foot = maybe(f"<footer>&copy; {words(1, 4)}</footer>", 0.4)
        return rng.choice([f"{menu}{own}", f"<body>{menu}{own}{foot}</body>", f"<html><body>{menu}{own}{foot}</body></html>", f"<html><head><title>{words(2, 6)}</title></head><body>{menu}{own}{foot}</body></html>"])

    box = rng.choice(["article", "article", "article", "article", "main", 'div class="content"', 'div class="post-body"', 'div id="article"', 'section class="story"', 'div class="entry-content"', "div"])
    body = f"<{box} y>{content()}</{box.split()[0]}>"
    if rng.random() < 0.4:
        outer = rng.choice(['div class="container"', 'div id="page"', "main", 'div class="wrapper row"', "div"])
        body = f"<{outer}>{maybe(noise(), 0.4)}{body}{maybe(noise(), 0.6)}</{outer.split()[0]}>"
    head = maybe(f'<header{maybe(" class=masthead")}>{maybe(f"<h1>{words(1, 3)}</h1>", 0.4)}{maybe(links())}<p>{words(2, 9)}</p></header>', 0.5) + maybe(f"<nav>{links()}</nav>", 0.7)
    head += "".join(noise() for _ in range(rng.randint(0, 2)))
    foot = "".join(noise() for _ in range(rng.randint(0, 3))) + maybe(rng.choice([f"<footer>&copy; {words(1, 3)} {prose(1, 3)}</footer>", f"<div class=footer><p>&copy; {words(2, 8)}</p>{links()}</div>", f"<footer><p>{prose(1, 2)}</p>{links()}</footer>"]), 0.8)
    if rng.random() < 0.08:  # the article has no box: it stands in the body, between what else does
        body = "".join(rng.choice([f"<p y>{prose()}</p>", f"<p y>{prose(2, 6)}{maybe('<br>' + prose())}</p>", f"<h1 y>{words(2, 8)}</h1><p y>{prose()}</p>"]) for _ in range(rng.choice([1, 1, 2, 3])))
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{head}{body}{foot}</body></html>"


def train(pages: int = 1200, seed: int = 11) -> Boosted:
    """Trees learned from ``pages`` composed pages; the blocks of small pages weigh more, up to five times."""
    rng, known = random.Random(seed), {}
    xs, ys = [], []
    for _ in range(pages):
        page = Page(_compose(rng, 0.45))
        ys.append(np.array([bool(re.search(r"\sy$", a)) for a in page.attrs], float))
        page.attrs = [re.sub(r"\sy$", "", a) for a in page.attrs]
        xs.append(features(page, known))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys), np.concatenate([np.full(len(y), min(5.0, max(1.0, 25 / len(y)))) for y in ys]))


def extract(sources: list[str], model: Boosted, known: dict | None = None) -> list[str]:
    """The main text of every page."""
    known = {} if known is None else known
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    odds = model(np.concatenate([features(p, known) for p in pages]))
    out, at = [], 0
    for p in pages:
        own = odds[at : at + len(p.tags)]
        at += len(p.tags)
        out.append(p.text(decode(p, own)))
    return out


COLUMNS = "page_id long, url string, text string, n_chars long"


def _scan(model: Boosted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            for at in range(0, len(batch), 200):
                own = batch.iloc[at : at + 200]
                texts = extract(own["html"].tolist(), model, known)
                yield pd.DataFrame({"page_id": ids(own, "page_id"), "url": own["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return run


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row per page: page_id, url, text (empty if there is none), n_chars.

    Null and empty html give an empty text. Text that stands in no block element, or
    in a body by itself, is read as a paragraph of its own. The content of script, style, noscript, template,
    textarea, title, iframe, svg, math, object, canvas, audio, video and select is
    dropped wherever it stands, in articles as well, and so are comments and CDATA. Unclosed and unmatched tags, and html cut
    off anywhere, are parsed as far as they go. Repeated rows and null ids or urls
    pass. Empty table: no rows. Other columns are not read.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return exact_ids(rows, "page_id").mapInPandas(_scan(model or train()), COLUMNS)


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return main_text(table(spark, sf_dir, "pages"))
