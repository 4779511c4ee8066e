"""Main text of web pages: gradient-boosted trees over DOM nodes with hierarchical decoding.

A tolerant parser builds a tree of block elements; runs of inline content become leaf blocks. Scripts, styles, markup comments and
the head never enter it. Each node gets features of its subtree (size, link and tag density, punctuation), its tag, attribute tokens, depth
and siblings; boosted trees give the probability that it holds main text. Decoding picks the likeliest labelling in which nothing
below a dropped node is kept: one pass up the tree sums log-probabilities, one pass down reads the choice.

There are no labelled pages, so the trees are trained here on TRAINING_PAGES pages that are generated from a grammar of layouts with known
roles (articles, menus, headers, footers, sidebars, notices, adverts, forms, reader comments); the bound is that parameter. The seed is
fixed, so the model is the same in every run.

Defined results: a null or empty html, or a page without main text, gives the empty text; unclosed and stray tags are mended as
browsers do for paragraphs and list items; repeated rows give repeated results; null keys and urls are passed on; an empty table gives no rows; extra
columns are ignored; pages of any length are read whole, and no recursion limits their depth.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.common import held, lean, slices

TRAINING_PAGES = 900
TREES, DEPTH, BINS, RATE = 60, 4, 32, 0.25

# ---- parsing ------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_HEAD_END = re.compile(r"</head\s*>|<body[\s>]", re.I)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "textarea", "select", "title", "noembed", "noframes", "xmp", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
SCOPE = {"table", "td", "th", "button", "body", "html", "article", "section", "main", "aside", "nav", "footer", "header"}


class Node:
    __slots__ = ("tag", "tokens", "hidden", "parent", "children", "depth", "text", "chars", "links", "tags", "paragraphs", "blocks", "stops", "place")

    def __init__(self, tag, tokens, hidden, parent):
        self.tag, self.tokens, self.hidden, self.parent = tag, tokens, hidden, parent
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.text = ""
        self.chars = self.links = self.tags = self.paragraphs = self.blocks = self.stops = self.place = 0
        if parent:
            self.place = len(parent.children)
            parent.children.append(self)


def attributes(source: str) -> tuple[frozenset, bool]:
    """(words of class, id, role and itemprop; whether the element is hidden)."""
    words, hidden = [], False
    for name, a, b, c in _ATTR.findall(source):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "data-role", "aria-label"):
            words += _WORDS.findall(_CAMEL.sub(" ", value).lower())
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return frozenset(words), hidden


def parse(source: str) -> Node:
    """The tree of block elements; inline runs are leaves with tag "#"."""
    root = top = Node("#root", frozenset(), False, None)
    run: list[str] = []
    linked = inline_tags = 0
    in_link = 0
    opened: Counter = Counter()  # tags of the open elements: what isn't open is never looked for up the tree
    last_end = source.rfind(">")
    heads_end = True

    def rise(node):
        """Closes all that is open below node."""
        nonlocal top
        while top is not node:
            opened[top.tag] -= 1
            top = top.parent

    def flush():
        nonlocal run, linked, inline_tags
        text = _SPACE.sub(" ", html_lib.unescape("".join(run)).replace("\0", "")).strip()
        if text:
            leaf = Node("#", frozenset(), False, top)
            leaf.text = text
            leaf.links = min(linked, len(text))
            leaf.tags = inline_tags
        run, linked, inline_tags = [], 0, 0

    at, size = 0, len(source)
    while at < size:
        begin = source.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            piece = source[at:begin]
            run.append(piece)
            if in_link:
                linked += len(piece.strip())
        if begin == size:
            break
        # Without an end further on only comments and declarations go on to the end of the page; a tag whose quotes don't close ends at the
        # next >, so that each character is looked at a few times only, whatever the page holds.
        m = _TOKEN.match(source, begin) if begin < last_end or source.startswith(("!", "?"), begin + 1) else None
        if m is None and begin < last_end:
            m = _PLAIN_TAG.match(source, begin)
        if m is None:  # a lone <
            run.append("<")
            at = begin + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag in INLINE or tag in VOID:
                if tag == "a" and in_link:
                    in_link = 0
                if tag == "br":
                    run.append(" ")
                continue
            if not opened[tag]:
                continue
            node = top
            while node is not root and node.tag != tag and not (tag not in SCOPE and node.tag in SCOPE and node.tag not in ("td", "th")):
                node = node.parent
            if node is not root and node.tag == tag:
                flush()
                in_link = 0
                rise(node.parent)
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(source, at)
                at = end.end() if end else size
            run.append(" " if tag in ("svg", "math", "select", "textarea") else "")
            continue
        if tag == "head":
            end = _HEAD_END.search(source, at) if heads_end else None
            heads_end = end is not None
            if end:
                at = end.start() if end[0].lower().startswith("<body") else end.end()
            continue
        if tag in ("html",):
            continue
        if tag in INLINE or (tag in VOID and tag != "hr"):
            inline_tags += 1
            if tag == "a":
                in_link = 1
            if tag in ("br", "wbr", "img", "input"):
                run.append(" " if tag != "wbr" else "")
            continue
        flush()
        in_link = 0
        if tag in CLOSES_P and opened["p"]:
            node = top
            while node is not root and node.tag != "p" and node.tag not in SCOPE and node.tag not in ("div", "li", "blockquote"):
                node = node.parent
            if node.tag == "p":
                rise(node.parent)
        if tag in SIBLING:
            node, found, left = top, None, sum(opened[t] for t in SIBLING[tag])
            while left and node is not root and node.tag not in STOPS[tag]:
                if node.tag in SIBLING[tag]:
                    found = node
                    left -= 1
                node = node.parent
            if found is not None:
                rise(found.parent)
        if tag == "hr":
            continue
        tokens, hidden = attributes(m[3]) if m[3] else (frozenset(), False)
        if "-" in tag:
            tokens |= frozenset(_WORDS.findall(tag))
        top = Node(tag, tokens, hidden, top)
        opened[tag] += 1
    flush()
    return root


def listed(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += node.children[::-1]
    return out


# ---- features -----------------------------------------------------------------------------------------------------------

#: Words of attributes by what they speak for.
HINTS = [
    set("article content post entry main body story text page blog news prose markdown".split()),
    set("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs sitemap skip links submenu dropdown".split()),
    set("footer foot copyright legal colophon imprint bottom".split()),
    set("header masthead banner topbar logo branding top hero".split()),
    set("sidebar side aside widget widgets rail related recommended more popular trending tags".split()),
    set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted affiliate adsense dfp commercial".split()),
    set("cookie cookies consent gdpr notice alert popup modal overlay banner message warning privacy paywall toast announcement".split()),
    set("comment comments commentlist reply replies respond disqus discussion feedback reader responses review reviews thread".split()),
    set("form login signup signin register newsletter subscribe subscription search contact field input".split()),
    set("share sharing social facebook twitter follow print email byline author meta".split()),
]
TAGS = [
    {"article", "main"}, {"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside", "dialog"}, {"form", "fieldset", "button", "label", "legend"}, {"p", "blockquote", "pre", "figcaption"},
    {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"div", "center"}, {"section"}, {"table", "tbody", "thead", "tr"}, {"td", "th"}, {"#"}, {"body", "#root"},
]
_TAG_AT = {t: i for i, some in enumerate(TAGS) for t in some}
N_HINTS, N_TAGS = len(HINTS), len(TAGS)
_HINT_AT: dict[str, list[int]] = {}
for _i, _some in enumerate(HINTS):
    for _w in _some:
        _HINT_AT.setdefault(_w, []).append(_i)
FEATURES = 13 + N_HINTS * 2 + N_TAGS + 7


def features(nodes: list[Node]) -> np.ndarray:
    for node in reversed(nodes):
        if node.tag == "#":
            node.chars, node.blocks, node.paragraphs = len(node.text), 1, 0
            node.stops = node.text.count(".") + node.text.count(",") + node.text.count("。") + node.text.count("、")
        p = node.parent
        if p is not None:
            p.chars += node.chars
            p.links += node.links
            p.tags += node.tags + 1
            p.paragraphs += node.paragraphs + (node.tag == "p")
            p.blocks += node.blocks
            p.stops += node.stops
    total = max(1, nodes[0].chars)
    x = np.zeros((len(nodes), FEATURES), np.float32)
    seen: dict[int, int] = {}
    above: dict[int, tuple] = {}
    for i, node in enumerate(nodes):
        seen[id(node)] = i
        p = node.parent
        chars = max(1, node.chars)
        siblings = p.children if p is not None else [node]
        row = [
            math.log1p(node.chars), node.links / chars, node.tags * 100 / chars, node.depth, len(node.children), node.place / max(1, len(siblings) - 1), len(siblings),
            node.chars / total, chars / max(1, node.blocks), node.stops * 100 / chars, node.paragraphs, node.chars / max(1, p.chars if p is not None else chars), node.hidden,
        ]
        before = siblings[node.place - 1] if node.place else None
        after = siblings[node.place + 1] if node.place + 1 < len(siblings) else None
        row += [before.chars / chars if before else -1, after.chars / chars if after else -1, _TAG_AT.get(before.tag, -1) if before else -2, _TAG_AT.get(after.tag, -1) if after else -2]
        own = [0] * N_HINTS
        for w in node.tokens:
            for k in _HINT_AT.get(w, ()):
                own[k] += 1
        up, up_tags, up_hidden = above[id(p)] if p is not None else ([0] * N_HINTS, 0, False)
        bit = 1 << _TAG_AT.get(node.tag, N_TAGS)
        above[id(node)] = ([a + b for a, b in zip(up, own, strict=True)] if any(own) else up, up_tags | bit, up_hidden or node.hidden)
        tag = [0] * N_TAGS
        if node.tag in _TAG_AT:
            tag[_TAG_AT[node.tag]] = 1
        row += own + up + tag + [(up_tags >> 0) & 1, (up_tags >> 5) & 1, up_hidden or (up_tags >> 1) & 1 or (up_tags >> 3) & 1 or (up_tags >> 4) & 1]
        x[i] = row
    return x


# ---- boosted trees ------------------------------------------------------------------------------------------------------


class Boosted:
    """Binary gradient boosting with histogram splits; trees are full binary trees of DEPTH levels."""

    def __init__(self):
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(n, self.base)
        inner = 2**DEPTH - 1
        offsets = np.arange(f) * BINS
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
            at = np.zeros(n, np.int64)
            for node in range(inner):
                who = np.flatnonzero(at == node)
                if len(who) >= 20:
                    flat = (binned[who] + offsets).ravel()
                    gs = np.bincount(flat, np.repeat(g[who], f), f * BINS).reshape(f, BINS).cumsum(1)
                    hs = np.bincount(flat, np.repeat(h[who], f), f * BINS).reshape(f, BINS).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    for j, e in enumerate(edges):
                        gain[j, len(e) :] = 0
                    best = int(gain.argmax())
                    if gain.ravel()[best] > 0.5:
                        feature[node], cut[node] = best // BINS, edges[best // BINS][best % BINS]
                right = x[who, feature[node]] > cut[node]
                at[who] = 2 * node + 1 + right
            leaf = at - inner
            gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            value = -RATE * gl / (hl + 1)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            score += value[at - len(feature)]
        return score


# ---- decoding -----------------------------------------------------------------------------------------------------------


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest labels in which a kept node's ancestors are all kept. The root is kept."""
    n = len(nodes)
    index = {id(node): i for i, node in enumerate(nodes)}
    keep = -np.logaddexp(0, -odds)  # log p
    drop = -np.logaddexp(0, odds)  # log (1 - p)
    best, gone = keep.copy(), drop.copy()
    for i in range(n - 1, 0, -1):
        p = index[id(nodes[i].parent)]
        best[p] += max(best[i], gone[i])
        gone[p] += gone[i]
    out = [False] * n
    out[0] = True
    for i in range(1, n):
        out[i] = out[index[id(nodes[i].parent)]] and bool(best[i] > gone[i])
    return out


def extract(pages: list, model: Boosted) -> list[str]:
    """The main text of each html."""
    trees = [listed(parse(p)) if isinstance(p, str) and p else [] for p in pages]
    some = [features(t) for t in trees if t]
    if not some:
        return [""] * len(pages)
    odds = model.log_odds(np.concatenate(some))
    out, at = [], 0
    for nodes in trees:
        if not nodes:
            out.append("")
            continue
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join(node.text for node, k in zip(nodes, kept, strict=True) if k and node.tag == "#"))
    return out


# ---- training pages -----------------------------------------------------------------------------------------------------


_TAGS = re.compile("<[^>]*>")


class Layout:
    """Writes one random page and the labels of its nodes: main text is marked by attributes that parsing doesn't show the model."""

    MAIN = [("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("section", "story"), ("div", ""), ("div", "text"), ("article", "post"), ("main", "page-content"), ("td", ""), ("div", "article-body"), ("article", ""), ("article", ""), ("", "")]

    def __init__(self, rnd: random.Random):
        self.r = rnd
        letters = rnd.choice(["etaoinshrdlu", "enisratdhulcg", "eaosnrildtu", "esaitnrulod", "оеаинтсрвл", "的一是不了人我在有他"])
        self.words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(300)]

    def sentence(self, low=3, high=18) -> str:
        s = " ".join(self.r.choice(self.words) for _ in range(self.r.randint(low, high)))
        return (s[:1].upper() + s[1:]) + self.r.choice([".", ".", ".", "!", "?", ""])

    def prose(self, low=1, high=6) -> str:
        parts = [self.sentence() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.2:
            parts.insert(0, f'<a href="/{self.r.choice(self.words)}">{self.sentence(1, 3)}</a>')
        text = " ".join(parts)
        if self.r.random() < 0.3:
            text = text.replace(" ", f" <{self.r.choice(['b', 'em', 'span', 'i'])}>", 1)
        return text.replace(", ", "&amp; ") if self.r.random() < 0.2 else text

    def cls(self, *names) -> str:
        """A class or id made of one of names; often with a random suffix, sometimes none at all."""
        if self.r.random() < 0.15:
            return ""
        name = self.r.choice(names)
        name = name if self.r.random() < 0.6 else f"{self.r.choice(['js', 'c', 'site', 'block', 'x'])}-{name}"
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def items(self, n, link=True) -> str:
        one = [f'<li>{f"<a href=#>{self.sentence(1, 4)}</a>" if link else self.sentence(2, 10)}' + self.r.choice(["</li>", ""]) for _ in range(n)]
        return f"<ul>{''.join(one)}</ul>"

    def noise(self) -> str:
        r = self.r
        kind = r.choice(["nav", "nav", "header", "footer", "footer", "side", "ad", "ad", "notice", "comments", "form", "share", "crumbs"])
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul", "menu"])
            body = self.items(r.randint(3, 9)) if r.random() < 0.7 else " ".join(f"<a href=#>{self.sentence(1, 2)}</a>" for _ in range(r.randint(3, 8)))
            return f"<{tag}{self.cls('nav', 'menu', 'navbar', 'main-menu') if tag != 'nav' or r.random() < .4 else ''}>{body}</{tag}>"
        if kind == "header":
            tag = r.choice(["header", "header", "div"])
            return f"<{tag}{self.cls('header', 'site-header', 'masthead', 'topbar') if tag == 'div' or r.random() < .4 else ''}>{r.choice(['<h1>%s</h1>', '<a href=/>%s</a>', '<p>%s</p>', '<div>%s</div>']) % self.sentence(1, 5)}{r.choice(['', self.sentence(2, 8)])}</{tag}>"
        if kind == "footer":
            tag = r.choice(["footer", "footer", "div"])
            inner = r.choice(["&copy; %s &middot; " % self.sentence(1, 2) + self.prose(1, 2), "<p>&copy; %s</p>" % self.prose(1, 3), self.items(r.randint(2, 5)), "<p>%s</p>" % self.sentence(2, 9)])
            return f"<{tag}{self.cls('footer', 'site-footer', 'copyright') if tag == 'div' or r.random() < .4 else ''}>{inner}</{tag}>"
        if kind == "side":
            tag = r.choice(["aside", "aside", "div", "section"])
            inner = r.choice([f"<h3>{self.sentence(1, 3)}</h3>" + self.items(r.randint(2, 8)), f"<p>{self.prose(1, 3)}</p>", f"<div>{self.prose(1, 2)}</div>" * r.randint(1, 3)])
            return f"<{tag}{self.cls('sidebar', 'widget', 'related', 'side-rail') if tag != 'aside' or r.random() < .4 else ''}>{inner}</{tag}>"
        if kind == "ad":
            tag = r.choice(["div", "div", "section", "aside", "p"])
            inner = self.prose(1, 4) if r.random() < 0.6 or tag == "p" else f"<p>{self.prose(1, 3)}</p><a href=#>{self.sentence(1, 3)}</a>"
            return f"<{tag} {r.choice(['class', 'id'])}=\"{r.choice(['ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'advertisement', 'ad-banner'])}\">{inner}</{tag}>"
        if kind == "notice":
            tag = r.choice(["div", "div", "section", "aside", "dialog"])
            return f"<{tag} class=\"{r.choice(['cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'popup', 'gdpr-banner', 'announcement'])}\">{r.choice(['<p>%s</p>', '%s', '<div>%s</div>']) % self.prose(1, 4)}{r.choice(['', '<button>OK</button>', '<a href=#>OK</a>'])}</{tag}>"
        if kind == "comments":
            tag = r.choice(["section", "div", "ol", "ul", "aside"])
            inner_tag = r.choice(["div", "article", "li", "p"])
            each = "".join(f"<{inner_tag} class=\"{r.choice(['comment', 'reply', 'comment-body'])}\">{r.choice(['%s', '<p>%s</p>', '<b>x</b> %s'] if inner_tag != 'p' else ['%s']) % self.prose(1, 5)}</{inner_tag}>" for _ in range(r.randint(1, 6)))
            return f"<{tag} {r.choice(['class', 'id'])}=\"{r.choice(['comments', 'comment-list', 'reader-comments', 'discussion', 'responses'])}\">{r.choice(['', '<h2>%s</h2>' % self.sentence(1, 3)])}{each}</{tag}>"
        if kind == "form":
            return f"<form{self.cls('search', 'login', 'newsletter', 'contact')}>{r.choice(['<p>%s</p>', '<label>%s</label>', '%s']) % self.sentence(1, 9)}<input name=q><button>{self.sentence(1, 2)}</button></form>"
        if kind == "share":
            return f"<div{self.cls('share', 'social', 'tags', 'follow')}>{' '.join(f'<a href=#>{self.sentence(1, 2)}</a>' for _ in range(r.randint(2, 6)))}</div>"
        return f"<div{self.cls('breadcrumb', 'breadcrumbs', 'pagination')}><a href=/>x</a> &gt; <a href=#>{self.sentence(1, 2)}</a> &gt; {self.sentence(1, 3)}</div>"

    def block(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.08:
            return f"<p>{r.choice(['', '<b>'])}{self.sentence(1, 5)}" + r.choice(["</p>", "<br>", ""])
        if kind < 0.62:
            return f"<p>{self.prose()}" + r.choice(["</p>", "</p>", "</p>", ""])
        if kind < 0.7:
            return f"<h{(n := r.randint(2, 4))}>{self.sentence(1, 8)}</h{n}>"
        if kind < 0.78:
            return self.items(r.randint(2, 6), link=r.random() < 0.15)
        if kind < 0.84:
            return f"<blockquote>{r.choice(['%s', '<p>%s</p>']) % self.prose(1, 3)}</blockquote>"
        if kind < 0.88:
            return f"<pre>{self.prose(1, 2)}</pre>"
        if kind < 0.92:
            return f"<table><tr><td>{self.sentence(1, 4)}<td>{self.sentence(1, 4)}</tr><tr><td>{self.sentence(1, 4)}</td><td>{self.sentence(1, 4)}</td></tr></table>"
        if kind < 0.96:
            return f"<div>{self.prose(1, 4)}</div>"
        return f"<p><b>{self.prose(1, 4)}<br><p>{self.prose(1, 3)}</p>"

    def page(self) -> str:
        """Noise is wrapped in <x-noise>, main text in <x-main>; labels() reads and removes them."""
        r = self.r
        noise = lambda low, high: "".join(f"<x-noise>{self.noise()}</x-noise>" for _ in range(r.randint(low, high)))
        tag, name = r.choice(self.MAIN)
        blocks = [self.block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14, 25]))]
        if r.random() < 0.25:
            blocks.insert(r.randint(0, len(blocks)), f"<x-noise>{self.noise()}</x-noise>")
        if r.random() < 0.2:
            blocks.append(f"<x-noise>{self.noise()}</x-noise>")
        title = r.choice(["", f"<h1>{self.sentence(1, 12)}</h1>", f"<h1>{self.sentence(1, 12)}</h1>", f"<header><h1>{self.sentence(1, 12)}</h1></header>", f"<h2>{self.sentence(1, 9)}</h2>"])
        attr = f' {r.choice(["class", "id"])}="{name}"' if name else ""
        if title and r.random() < 0.3:  # a lead that repeats the title
            blocks.insert(0, f"<p><b>{_TAGS.sub('', title)}<br>")
        inside = title + "".join(blocks)
        main = f"<x-main><{tag}{attr}>{inside}</{tag}></x-main>" if tag else f"<x-main>{inside}</x-main>"
        if r.random() < 0.06:  # a page without an article
            main = ""
        if tag == "td" and main:
            main = f"<table><tr><x-noise><td>{self.items(4)}</td></x-noise>{main}</tr></table>"
        for _ in range(r.randint(0, 2)):
            before, after = noise(0, 1), noise(0, 2)
            wrap = r.choice(["div", "section", "main", "div"])
            main = f"<{wrap}{self.cls('wrapper', 'container', 'layout', 'row', 'page') if r.random() < .5 else ''}>{before}{main}{after}</{wrap}>"
        return f"<!DOCTYPE html><html><head><title>{self.sentence(1, 5)}</title><style>p{{}}</style></head><body>{noise(0, 4)}{main}{noise(0, 5)}</body></html>"


def labels(nodes: list[Node]) -> tuple[list[Node], list[int]]:
    """Nodes without the marks, and 1 for those that hold main text or are part of it."""
    role: dict[int, str] = {}
    for node in nodes:
        role[id(node)] = node.tag if node.tag in ("x-main", "x-noise") else role[id(node.parent)] if node.parent else ""
    holds = {id(n): n.tag == "#" and role[id(n)] == "x-main" for n in nodes}
    for node in reversed(nodes):
        if node.parent and holds[id(node)]:
            holds[id(node.parent)] = True
    for node in (n for n in nodes if n.tag not in ("x-main", "x-noise")):  # children of marks move up
        while any(c.tag in ("x-main", "x-noise") for c in node.children):
            node.children = [g for c in node.children for g in (c.children if c.tag in ("x-main", "x-noise") else [c])]
        for i, c in enumerate(node.children):
            c.parent, c.place, c.depth = node, i, node.depth + 1
    out = listed(nodes[0])
    return out, [int(holds[id(n)]) for n in out]


def train(pages: int = TRAINING_PAGES, seed: int = 5) -> Boosted:
    xs, ys = [], []
    for i in range(pages):
        nodes, y = labels(listed(parse(Layout(random.Random(seed * 1_000_003 + i)).page())))
        xs.append(features(nodes))
        ys.append(y)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_text(pages: DataFrame, model: Boosted, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """key_col, url_col, text, n_chars for each row. No shuffle; the model (TREES trees) travels with the task."""
    narrow = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(frames):
        held(("html",), dict)  # drops what an earlier stage has cached
        for b in slices(frames, "html", 1 << 20):
            text = extract(b["html"].to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b["key"], b["url"], pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=[key_col, url_col, "text", "n_chars"])

    return narrow.mapInArrow(lean(run), f"{key_col} long, {url_col} string, text string, n_chars long")
