"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its block elements, with each run of text between
block boundaries as a leaf.  Two gradient-boosted ensembles look at every node
(text, links and words of its subtree and their densities, attribute tokens and
tags of its own and of its ancestors, depth, place among its siblings and on
the page): does it hold main text, and is all its text main text?  The most
probable labelling of the whole tree under three states follows: a node
without main text has only such nodes below it, a pure one only pure ones, a
mixed one any.  So no answer for a node contradicts that for its ancestors.

The ensembles are trained here on pages that ``sample_page`` makes up from
varied layouts, a third of them with names that mean nothing, where the origin
of each text is known; nothing is fitted to the tables.  ``python -m
corvane.llm.html_text`` trains them and writes ``html_model.npz``; a file that
another recipe made is not used, but trained anew.

Defined results: titles, scripts, styles, templates, embedded objects and
comments hold no text, and run to the end of the page if nothing closes them;
the head needs no end tag, what is text in it belongs to the body; SVG and
MathML hold no text and end at an end tag, as an empty element or where an
element of HTML begins or ends; a line break is white space, as is any other Unicode white
space; character references are decoded within a run of text, so that markup
between their parts keeps them apart; quotes count in a tag only after "=" and
if they close; a tag without ">" ends where the next "<" begins; a null or empty page, or one without main
text, gives the empty text; repeated rows and null page_ids stay; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import html
import inspect
import io
import math
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.common import texts, tune

# --- the tree -----------------------------------------------------------------

#: What stands in a tag. No "<" outside quotes: a start that fails has read no further than the next one.
_ATTRS = r"(?:[^<>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+"
#: Elements that cannot stand in SVG or MathML: their tags end it, closed or not.
_BREAKS = "html|head|body|p|h[1-6]|hgroup|hr|li|dt|dd|ul|ol|dl|menu|div|center|section|article|main|nav|header|footer|address|aside|dialog|form|fieldset|button|legend|details|table|tr|td|th|tbody|thead|tfoot|caption|blockquote|pre|listing|figure|figcaption|b|big|br|code|em|embed|i|img|meta|nobr|ruby|s|small|span|strong|strike|sub|sup|tt|u|var"
_INNER = "|".join(rf"<{x}(?=[\s/>]){_ATTRS}>(?:(?<=/>)|.*?(?:</{x}\s*>|{end}\Z))" for names, end in (("foreignObject annotation-xml", ""), ("desc title mi mo mn ms mtext", r"(?=</(?:svg|math)\s*>)|")) for x in names.split())
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|template|noscript|iframe|object|title|textarea|select|canvas)(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    # SVG and MathML may be empty elements; HTML inside some of their elements does not end them.
    rf"|<(?P<foreign>svg|math)(?=[\s/>]){_ATTRS}>(?:(?<=/>)|(?:[^<]++|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|{_INNER}"
    rf"|<(?!/(?P=foreign)[\s>]|/?(?:{_BREAKS})[\s/>]))*+(?:</(?P=foreign)\s*>)?)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*+>?",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")

#: Tags by kind; a kind is a feature. Elements of other tags are inline.
KINDS = {
    "text": [],
    "paragraph": ["p"],
    "heading": ["h1", "h2", "h3", "h4", "h5", "h6", "hgroup"],
    "item": ["li", "dt", "dd"],
    "list": ["ul", "ol", "dl", "menu"],
    "division": ["div", "center", "details", "summary"],
    "section": ["section"],
    "article": ["article"],
    "main": ["main"],
    "nav": ["nav"],
    "header": ["header"],
    "footer": ["footer", "address"],
    "aside": ["aside", "dialog"],
    "form": ["form", "fieldset", "button", "legend"],
    "table": ["table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"],
    "quote": ["blockquote", "pre", "figure", "figcaption", "hr"],
    "page": ["html", "body"],
}
#: Attribute tokens by kind; a kind is a feature.
TOKENS = {
    "nav": ["nav", "navbar", "menu", "navigation", "breadcrumb", "breadcrumbs", "tabs", "pagination", "pager", "toc"],
    "head": ["header", "masthead", "topbar", "logo", "branding", "banner", "hero"],
    "foot": ["footer", "copyright", "colophon", "legal", "bottom", "contentinfo"],
    "side": ["sidebar", "side", "aside", "widget", "rail", "complementary", "secondary"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "banners", "outbrain", "taboola"],
    "notice": ["cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay", "alert", "dialog", "subscribe", "newsletter", "paywall"],
    "comment": ["comment", "comments", "reply", "replies", "disqus", "respond", "discussion", "reactions"],
    "form": ["form", "search", "login", "signup", "register", "contact", "input"],
    "share": ["share", "sharing", "social", "follow", "related", "recommended", "more", "trending", "popular", "tags", "links"],
    "content": ["content", "article", "post", "entry", "main", "story", "body", "text", "prose", "articlebody", "page"],
}
_KIND_OF = {tag: i for i, tags in enumerate(KINDS.values()) for tag in tags}
_TOKEN_OF = {token: i for i, tokens in enumerate(TOKENS.values()) for token in tokens}
_N_KINDS, _N_TOKENS = len(KINDS), len(TOKENS)
#: Kinds of tags and tokens counted together in two more features.
_AWAY = [list(TOKENS).index(t) for t in ("nav", "foot", "side", "advert", "notice", "comment", "form", "share")] + [_N_TOKENS + list(KINDS).index(k) for k in ("nav", "footer", "aside", "form")]
_TOWARDS = [list(TOKENS).index("content")] + [_N_TOKENS + list(KINDS).index(k) for k in ("article", "main")]
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}


class Tree:
    """Nodes of one page in document order."""

    __slots__ = ("kind", "parent", "end", "depth", "own", "above", "tokens", "chars", "links", "words", "stops", "text", "place")

    def __init__(self, page: str | None):
        self.kind, self.parent, self.end, self.depth, self.own, self.above = [_N_KINDS - 1], [-1], [0], [0], [0], [0]
        self.chars, self.links, self.words, self.stops, self.text, self.place = [0], [0], [0], [0], [""], [0]
        self._read(page or "")

    def _add(self, kind: int, parent: int, marks: int) -> int:
        i = len(self.kind)
        self.kind.append(kind)
        self.parent.append(parent)
        self.end.append(i)
        self.depth.append(self.depth[parent] + 1)
        self.own.append(marks)
        self.above.append(self.above[parent] | self.own[parent] | 1 << (_N_TOKENS + self.kind[parent]))
        self.chars.append(0)
        self.links.append(0)
        self.words.append(0)
        self.stops.append(0)
        self.text.append("")
        return i

    def _read(self, page: str) -> None:
        tags, nodes = [""], [0]  # open block elements
        open_: dict[str, list[int]] = {"": [0]}  # and the places of each tag among them
        buffer: list[str] = []
        linked = link_chars = 0

        def flush():
            nonlocal link_chars
            if buffer:
                text = " ".join("".join(buffer).split())
                buffer.clear()
                if text:
                    i = self._add(0, nodes[-1], 0)
                    self.text[i] = text
                    self.chars[i] = len(text)
                    self.links[i] = min(link_chars, len(text))
                    self.words[i] = text.count(" ") + 1
                    self.stops[i] = text.count(".") + text.count(",") + text.count("?") + text.count("!")
            link_chars = 0

        def close(to: int):
            last = len(self.kind) - 1
            while len(nodes) > to:
                self.end[nodes.pop()] = last
                open_[tags.pop()].pop()

        def say(piece: str):
            buffer.append(html.unescape(piece) if "&" in piece else piece)

        at = 0
        for m in _MARKUP.finditer(page):
            if m.start() > at:
                say(page[at : m.start()])
                if linked:
                    link_chars += len(buffer[-1])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            kind = _KIND_OF.get(tag)
            if kind is None:
                if tag == "a":
                    linked = not m["end"]
                elif tag == "br":
                    buffer.append(" ")
                continue
            flush()
            if m["end"]:
                if open_.get(tag):
                    close(open_[tag][-1])
                continue
            if tag in ("html", "body"):
                continue
            linked = 0
            if open_.get("p"):
                close(open_["p"][-1])
            for old in _CLOSES.get(tag, ()):
                if open_.get(old) and not any(open_.get(t) and open_[t][-1] > open_[old][-1] for t in _HOLDS[tag]):
                    close(open_[old][-1])
            marks = 0
            attrs = m["attrs"]
            if attrs and "=" in attrs:
                for values in _ATTR.findall(attrs):
                    for token in _NAME.findall("".join(values).lower()):
                        if token in _TOKEN_OF:
                            marks |= 1 << _TOKEN_OF[token]
            i = self._add(kind, nodes[-1], marks)
            if tag != "hr":
                open_.setdefault(tag, []).append(len(tags))
                tags.append(tag)
                nodes.append(i)
        if at < len(page):
            say(page[at:])
        flush()
        close(0)


def node_features(trees: list[Tree]) -> np.ndarray:
    """One row of features for each node of each tree, in order."""
    sizes = np.array([len(t.kind) for t in trees])
    base = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    flat = lambda name: np.array([x for t in trees for x in getattr(t, name)], np.int64)
    kind, parent, own, above = flat("kind"), flat("parent"), flat("own"), flat("above")
    n = len(kind)
    here = np.arange(n)
    end = flat("end") + base + 1
    up = np.where(parent < 0, here - base, parent) + base
    sums = {}
    for name in ("chars", "links", "words", "stops"):
        total = np.concatenate([[0], np.cumsum(flat(name))])
        sums[name] = (total[end] - total[here]).astype(float)
        sums[name + "_before"] = (total[here] - total[base]).astype(float)
    leaves = np.concatenate([[0], np.cumsum(kind == 0)])
    n_leaves, n_nodes = (leaves[end] - leaves[here]).astype(float), (end - here).astype(float)
    page = sums["chars"][base]
    order = np.lexsort((here, up))
    first = np.searchsorted(up[order], up[order])
    index = np.empty(n)
    index[order] = np.arange(n) - first
    siblings = np.bincount(up, minlength=n).astype(float)
    like_key = up * _N_KINDS + kind
    like = np.bincount(np.unique(like_key, return_inverse=True)[1])[np.unique(like_key, return_inverse=True)[1]]
    safe = np.maximum
    columns = [
        np.log1p(sums["chars"]),
        sums["links"] / safe(sums["chars"], 1),
        sums["chars"] / n_nodes,
        sums["words"] / safe(n_leaves, 1),
        100 * sums["stops"] / safe(sums["chars"], 1),
        sums["chars"] / safe(page, 1),
        sums["chars_before"] / safe(page, 1),
        np.log1p(n_leaves),
        flat("depth").astype(float),
        siblings[here],
        index,
        index / safe(siblings[up] - 1, 1),
        siblings[up],
        like / safe(siblings[up], 1),
        sums["links"][up] / safe(sums["chars"][up], 1),
        sums["chars"] / safe(sums["chars"][up], 1),
        np.log1p(page),
    ]
    marks = own | above | 1 << (_N_TOKENS + kind)
    columns += [sum(((marks >> i) & 1).astype(float) for i in bits) for bits in (_AWAY, _TOWARDS)]
    columns += [(kind == k).astype(float) for k in range(_N_KINDS)]
    columns += [((own >> t) & 1).astype(float) for t in range(_N_TOKENS)]
    columns += [((above >> t) & 1).astype(float) for t in range(_N_TOKENS + _N_KINDS)]
    return np.stack(columns, axis=1).astype(np.float32)


# --- boosted trees --------------------------------------------------------------


class Boosted:
    """Gradient-boosted trees of a fixed depth for a yes-or-no answer."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, share: float = 0.5):
        self.n, self.depth, self.rate, self.bins, self.share = trees, depth, rate, bins, share

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        n, leaves = len(y), 1 << self.depth
        base = y.mean()
        self.start = float(np.log(base / (1 - base)))
        self.feature = np.zeros((self.n, leaves - 1), np.int32)
        self.cut = np.full((self.n, leaves - 1), np.inf, np.float32)
        self.value = np.zeros((self.n, leaves))
        rng = np.random.default_rng(5)
        all_binned, all_y, everyone = binned, y, np.full(n, self.start)
        n = int(n * self.share)
        for t in range(self.n):
            # A random half of the rows and of the features grow each tree.
            rows = rng.choice(len(all_y), n, replace=False)
            tried = set(rng.choice(len(cuts), int(len(cuts) * self.share), replace=False).tolist())
            binned, y, score = all_binned[:, rows], all_y[rows], everyone[rows]
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                width = 1 << level
                best, choice = np.full(width, 1e-6), [(0, None)] * width
                for f, b in enumerate(binned):
                    if not len(cuts[f]) or f not in tried:
                        continue
                    bins = len(cuts[f]) + 1
                    key, size = node * bins + b, width * bins
                    gs = np.bincount(key, g, size).reshape(width, -1).cumsum(1)
                    hs = np.bincount(key, h, size).reshape(width, -1).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < 2) | (ht - hl < 2)] = 0
                    at = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(width), at] > best):
                        best[k], choice[k] = gain[k, at[k]], (f, int(at[k]))
                right = np.zeros(n, bool)
                for k, (f, c) in enumerate(choice):
                    i = width - 1 + k
                    if c is not None:
                        self.feature[t, i], self.cut[t, i] = f, cuts[f][c]
                        mine = node == k
                        right[mine] = binned[f][mine] > c
                node = 2 * node + right
            gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            self.value[t] = self.rate * gs / (hs + 1)
            everyone += self.value[t][self._leaf(t, x)]
        return self

    def _leaf(self, t: int, x: np.ndarray) -> np.ndarray:
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.cut[t][node])
        return node - len(self.cut[t])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of yes."""
        score = np.full(len(x), self.start)
        for t in range(self.n):
            score += self.value[t][self._leaf(t, x)]
        return 1 / (1 + np.exp(-score))


# --- training pages --------------------------------------------------------------

#: Stands before every word of main text in a made-up page.
_MARK = ""


def _words(rng: random.Random, n: int, mark: str) -> str:
    out, start = [], True
    for _ in range(n):
        w = "".join(rng.choice("bcdfghklmnprstvw") + rng.choice(["a", "e", "i", "o", "u", "é", "ö", "ea"]) for _ in range(rng.randint(1, 4)))
        w = w.capitalize() if start else w
        start = rng.random() < 0.1
        out.append(mark + w + ("." if start else rng.choice(["", "", "", "", ","]) if rng.random() < 0.3 else ""))
    return " ".join(out) + ("." if rng.random() < 0.8 else "")


def sample_page(rng: random.Random, strange: float = 0.3) -> str:
    """A page of a random layout; words of main text carry a mark.

    With the probability ``strange`` its names (but those of adverts) are made
    up and say nothing of what they name.
    """
    r = rng.random
    odd = r() < strange
    side = lambda a, b: _words(rng, rng.randint(a, b), "")
    main = lambda a, b: _words(rng, rng.randint(a, b), _MARK)

    def attr(*names):
        if r() < 0.15:
            return ""
        return f' {rng.choice(["class", "class", "id"])}="{called(*names)}"'

    def called(*names):
        name = "".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randint(2, 7))) if odd else rng.choice(names)
        return name + rng.choice(["", "", "-wrap", "-box", " x1", "_2"])

    def links(n, tag="ul"):
        items = [f'<a href="/{i}">{side(1, 3)}</a>' for i in range(n)]
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{x}" + ("</li>" if r() < 0.8 else "") for x in items) + "</ul>"
        return rng.choice([" ", " | ", ""]).join(items)

    def advert():
        tag = rng.choice(["div", "div", "aside", "section"])
        inner = rng.choice([side(3, 25), f"<p>{side(3, 25)}</p>", f'<a href="#">{side(2, 9)}</a>', f"<p>{side(3, 12)}</p><p>{side(3, 12)}</p>"])
        return f'<{tag} class="{rng.choice(TOKENS["advert"])}{rng.choice(["", "-slot", " top"])}">{inner}</{tag}>'

    def menu():
        n = rng.randint(3, 9)
        return rng.choice([f"<nav{attr('nav', 'menu')}>{links(n)}</nav>", f"<div{attr('menu', 'navbar', 'navigation')}>{links(n)}</div>", f"<nav>{links(n, 'a')}</nav>", f'<ul class="{called("menu")}">{links(n)[4:]}'])

    def notice():
        return f'<div class="{called("cookie", "consent", "notice", "gdpr", "popup", "newsletter", "alert")}"><p>{side(6, 40)}</p><button>{side(1, 2)}</button></div>'

    def form():
        return f'<form{attr("search", "login", "contact", "newsletter")}><label>{side(1, 4)}</label><input name="q"><button>{side(1, 2)}</button>{"<p>" + side(4, 15) + "</p>" if r() < 0.4 else ""}</form>'

    def comments():
        t = rng.choice(["div", "li", "article", "div"])
        tag = rng.choice(["div", "section", "aside"])
        who, reply, times = r() < 0.5, r() < 0.4, r() < 0.3
        name = attr("comment", "reply")

        def one():
            head = rng.choice(["<b>{}</b>", "<h4>{}</h4>", "<span>{}</span>", "<div>{}</div>"]).format(side(1, 2)) if who else ""
            when = f"<small>{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{rng.randint(10, 26)} {rng.randint(0, 23)}:{rng.randint(10, 59)}</small>" if times else ""
            return f'<{t}{name}>{head}{when}<p>{side(3, 60)}</p>{"<a href=x>" + side(1, 1) + "</a>" if reply else ""}</{t}>'

        title = f"<h3>{side(1, 3)}</h3>" if r() < 0.8 else ""
        return f'<{tag} {rng.choice(["class", "id"])}="{called("comments", "disqus", "respond", "discussion", "replies", "comment-list")}">{title}{"".join(one() for _ in range(rng.randint(1, 7)))}</{tag}>'

    def sidebar():
        parts = [rng.choice([f"<h3>{side(1, 4)}</h3>{links(rng.randint(2, 7))}", f"<div{attr('widget')}><h4>{side(1, 3)}</h4><p>{side(8, 50)}</p></div>", f"<p>{side(6, 40)}</p>"]) for _ in range(rng.randint(1, 4))]
        return rng.choice([f"<aside{attr('sidebar', 'side')}>{{}}</aside>", f'<div class="{called("sidebar", "side", "widget", "rail")}">{{}}</div>']).format("".join(parts))

    def article():
        parts, n = [], rng.choice([rng.randint(1, 2), rng.randint(1, 3), rng.randint(1, 5), rng.randint(3, 14), rng.randint(10, 40)])
        if r() < 0.85:
            parts.append(f"<h1>{main(2, 12)}</h1>")
        for i in range(n):
            x = r()
            size = rng.choice([(1, 8), (8, 40), (20, 120), (60, 250)][: 2 if n < 3 and r() < 0.6 else 4])
            if x < 0.78:
                b = rng.choice(["", "", "", "<b>", "<i>"])
                body = b + main(*size) + ("" if r() < 0.4 else b.replace("<", "</"))
                if r() < 0.25:
                    body += f' <a href="/x">{main(1, 3)}</a> {main(1, 12)}'
                if r() < 0.1:
                    body += f"<br>{main(2, 20)}"
                parts.append(f"<p>{body}" + ("</p>" if r() < 0.9 else ""))
            elif x < 0.84:
                parts.append(f"<{rng.choice(['h2', 'h3'])}>{main(1, 8)}</h2>")
            elif x < 0.89:
                parts.append("<ul>" + "".join(f"<li>{main(1, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif x < 0.92:
                parts.append(f"<blockquote>{main(5, 50)}</blockquote>")
            elif x < 0.94:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{main(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            elif x < 0.97:
                parts.append(advert())
            elif x < 0.985:
                parts.append(f'<div class="{called("share", "social", "related")}">{links(rng.randint(2, 5), rng.choice(["ul", "a"]))}</div>')
            else:
                parts.append(form())
        if r() < 0.2:
            parts.append(f"<div{attr('content', 'text')}>{main(10, 120)}</div>")
        if r() < 0.08:
            parts.append(f"<details><summary>{main(1, 6)}</summary>{main(3, 40)}</details>")
        inner = "".join(parts)
        if r() < 0.2:
            inner = f"<div{attr('entry', 'text', 'body')}>{inner}</div>"
        shape = rng.choice(["<article{a}>{}</article>", "<article{a}>{}</article>", "<main{a}>{}</main>", "<div{a}>{}</div>", "<div{a}>{}</div>", "<section{a}>{}</section>", "<main><article{a}>{}</article></main>", "<div{a}>{}</div>", "<table><tr><td{a}>{}</td></tr></table>", "{}"])
        return shape.replace("{a}", attr("content", "article", "post", "entry", "main", "story") if r() < 0.7 else "").replace("{}", inner)

    maybe = lambda p, f: f() if r() < p else ""
    top = [maybe(0.25, notice), rng.choice(["<header{}>{}{}</header>", "<div{}>{}{}</div>"]).format(attr("header", "masthead", "topbar"), maybe(0.7, lambda: f"<h2>{side(1, 4)}</h2>"), maybe(0.7, menu)) if r() < 0.6 else menu(), maybe(0.4, advert), maybe(0.2, form)]
    if r() < 0.4:
        rng.shuffle(top)
    crumbs = maybe(0.2, lambda: f'<div class="{called("breadcrumbs")}">{links(3, "a")}</div>')
    columns = [crumbs + article() + maybe(0.3, comments), maybe(0.5, sidebar)]
    if r() < 0.25:
        columns.reverse()
    after = [maybe(0.15, comments), maybe(0.25, advert), maybe(0.25, lambda: f'<section class="{called("related")}"><h3>{side(1, 3)}</h3>{links(rng.randint(2, 6))}</section>'), maybe(0.15, form)]
    foot = maybe(0.85, lambda: rng.choice(["<footer{}>{}</footer>", "<div{}>{}</div>"]).format(attr("footer", "copyright", "bottom"), rng.choice([f"&copy; {side(1, 2)} &middot; {side(2, 14)}", f"&copy; {side(2, 20)}", side(3, 25), f"<p>{side(3, 30)}</p>", links(4, "a") + side(2, 8), f"<p>{side(3, 20)}</p>{links(5)}"])))
    body = "".join(top) + "".join(columns) + "".join(after) + foot + maybe(0.15, notice)
    if r() < 0.5:
        body = f"<div{attr('page', 'wrapper', 'container', 'site')}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{side(2, 9)}</title><script>var x=1</script></head><body>{body}" + ("</body></html>" if r() < 0.8 else "")


def _labels(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """For each node: holds main text; all its text is main. Removes the marks."""
    some, pure = [], []
    for t in trees:
        mine = [len(x) if _MARK in x else 0 for x in t.text]
        for i, x in enumerate(t.text):
            if _MARK in x:
                t.text[i] = x = x.replace(_MARK, "")
                t.chars[i] = len(x)
                t.links[i] = min(t.links[i], t.chars[i])
        total = np.concatenate([[0], np.cumsum(mine)])
        other = np.concatenate([[0], np.cumsum([0 if m else c for m, c in zip(mine, t.chars, strict=True)])])
        here, end = np.arange(len(mine)), np.array(t.end) + 1
        a, b = total[end] - total[here], other[end] - other[here]
        some += (a > 0).tolist()
        pure += ((a > 0) & (b == 0)).tolist()
    return np.array(some, float), np.array(pure, float)


MODEL = Path(__file__).with_name("html_model.npz")
_PARTS = ("feature", "cut", "value")


def recipe(pages: int, seed: int) -> str:
    """What the ensembles depend on, hashed."""
    code = [inspect.getsource(x) for x in (Tree, node_features, Boosted, sample_page, _words, _labels, fit)]
    return hashlib.sha256("\n".join([*code, _MARKUP.pattern, str((KINDS, TOKENS, pages, seed))]).encode()).hexdigest()


def fit(pages: int, seed: int) -> tuple[Boosted, Boosted]:
    """The two ensembles, trained on made-up pages."""
    rng = random.Random(seed)
    trees = [Tree(sample_page(rng)) for _ in range(pages)]
    some, pure = _labels(trees)
    x = node_features(trees)
    keep = x[:, 0] > 0  # nodes without text say nothing
    return Boosted().fit(x[keep], some[keep]), Boosted().fit(x[keep & (some > 0)], pure[keep & (some > 0)])


def save(models: tuple[Boosted, Boosted], made_by: str) -> bytes:
    out = io.BytesIO()
    parts = {f"{p}{i}": getattr(m, p) for i, m in enumerate(models) for p in _PARTS}
    np.savez_compressed(out, made_by=made_by, start=[m.start for m in models], **parts)
    return out.getvalue()


@functools.lru_cache(maxsize=1)
def trained(pages: int = 2000, seed: int = 11) -> tuple[Boosted, Boosted]:
    """The two ensembles, from the file if it has this recipe, or else trained now."""
    if MODEL.exists():
        with np.load(MODEL) as held:
            if str(held["made_by"]) == recipe(pages, seed):
                models = Boosted(), Boosted()
                for i, m in enumerate(models):
                    m.start = float(held["start"][i])
                    for p in _PARTS:
                        setattr(m, p, held[f"{p}{i}"])
                return models
    return fit(pages, seed)


# --- decoding ---------------------------------------------------------------------


def decode(tree: Tree, some: np.ndarray, pure: np.ndarray) -> list[bool]:
    """For each node whether its own text is main text, by the best labelling of the tree."""
    n = len(tree.kind)
    out, mixed, whole = [0.0] * n, [0.0] * n, [0.0] * n
    full = [0] * n
    for i in range(n - 1, -1, -1):
        full[i] += tree.chars[i]
        if full[i]:
            p, q = min(0.999, max(0.001, some[i])), min(0.999, max(0.001, pure[i]))
            out[i] += math.log(1 - p)
            if tree.kind[i]:
                whole[i] += math.log(p) + math.log(q)
                mixed[i] += math.log(p) + math.log(1 - q)
            else:
                whole[i] += math.log(p)
                mixed[i] = -math.inf
        up = tree.parent[i]
        if up >= 0:
            full[up] += full[i]
            out[up] += out[i]
            whole[up] += whole[i]
            mixed[up] += max(out[i], mixed[i], whole[i])
    state, main = [1] * n, [False] * n
    for i in range(n):
        above = state[tree.parent[i]] if i else 1
        if above != 1:
            state[i] = above
        else:
            state[i] = max((out[i], 0), (whole[i], 2), (mixed[i], 1))[1]
        main[i] = state[i] == 2
    return main


def extract(pages: list[str | None], models: tuple[Boosted, Boosted]) -> list[str]:
    """The main text of each page."""
    trees = [Tree(p) for p in pages]
    if not trees:
        return []
    x = node_features(trees)
    some, pure = (m.predict(x) for m in models)
    out, at = [], 0
    for t in trees:
        n = len(t.kind)
        main = decode(t, some[at : at + n].tolist(), pure[at : at + n].tolist())
        out.append("\n\n".join(text for text, m in zip(t.text, main, strict=True) if m and text))
        at += n
    return out


_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    tune(pages.sparkSession)
    models = trained()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                texts = extract(part.column("html").to_pylist(), models)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_PAGE)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(texts(spark, sf_dir, "pages"))


if __name__ == "__main__":
    from corvane.llm import html_text

    MODEL.write_bytes(html_text.save(html_text.fit(2000, 11), html_text.recipe(2000, 11)))
