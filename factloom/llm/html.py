"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

A reader takes tags, attributes, comments and raw text by position, as the HTML standard reads them: a quote within an unquoted
value is a character of it, and scripts, styles and other raw text end at their own closing tag whatever they hold. It builds
the tree of block elements (inline elements only mark links), drops what is never text (scripts, styles, templates, drawings,
controls, comments of the markup) and keeps text as blocks. Each node has features: its
element, tokens of class, id and role of its own and above it, text and link density of its subtree,
depth, place among its siblings and their statistics. Gradient-boosted trees give each node log odds of
being main text, weighted by the text that stands directly in it.

Hierarchical decoding: a node is outside, kept or dropped. Below outside a node may be outside or kept,
below kept it may be kept or dropped, below dropped all is dropped. The labelling of the highest total is found
from the leaves up, so no dropped part has kept descendants and no part is kept twice.

The trees are fitted on ``TRAINING_PAGES`` labelled pages that a generator of page layouts makes (its
words are random syllables, so no language is learned); that is the bound of the sample. Each page is read whole, by itself.

Defined cases: null or empty html has no text; a page without main text gives an empty string; unclosed and stray
tags are repaired by position; a quote that nothing closes is a plain character; a comment, script or style that nothing closes
holds the rest of the page, other raw elements that nothing closes are read as if they were not raw; repeated pages are
extracted each; a very long page is read whole; other columns pass through unread.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import boosting
from factloom.llm._common import arrow_column

TRAINING_PAGES = 600
ENTER, LEAVE = 0.25, 0.25

_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)?+"
_NAME = r"(?:=[^\s/>=]*+|[^\s/>=]++)"
_OPEN = re.compile(rf"<([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+)>", re.A)
_CLOSE = re.compile(rf"</([a-zA-Z][^\s/>]*+)(?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+>", re.A)
_ATTRIBUTE = re.compile(r"(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|((?![\"'])[^\s>]++))?+)?+", re.A)
_COMMENT_END = re.compile(r"--!?>")
_EMPTY_ELEMENT = re.compile(r"(?:^|[\s\"'])/$")
_SCRIPT_STATE = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I | re.A)

#: Elements whose content is not markup, and those left out with all they hold.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
LEFT_OUT = frozenset(("template", "svg", "select", "button", "option"))
VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"))
BLOCKS = ("body", "main", "article", "section", "div", "nav", "header", "footer", "aside", "form", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "fieldset", "legend", "menu", "dialog", "label", "button", "center", "hgroup", "search", "noscript")
_INDEX = {t: i for i, t in enumerate(BLOCKS)}
#: An opening tag of the key closes open elements of the values, up to the nearest container.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_CONTAINERS = frozenset(("ul", "ol", "dl", "table", "menu", "body", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "blockquote"))

GROUPS = {
    "good": ("article", "content", "main", "post", "entry", "body", "story", "text", "page"),
    "menu": ("nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs"),
    "ad": ("ad", "ads", "advert", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion"),
    "comment": ("comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "reviews"),
    "notice": ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "gdpr", "warning", "newsletter", "subscribe", "signup", "paywall"),
    "side": ("sidebar", "side", "aside", "related", "recommended", "widget", "trending", "popular", "more", "teaser", "recirc"),
    "edge": ("header", "footer", "masthead", "topbar", "bottom", "copyright", "legal", "site", "banner", "contentinfo"),
    "share": ("share", "social", "sharing", "follow", "tags", "meta", "byline", "author", "login", "search", "form", "navigation", "complementary"),
}
_TOKEN = re.compile(r"[a-z]+")
_GROUP_OF: dict[str, int] = {}
for _k, _words in enumerate(GROUPS.values()):
    for _w in _words:
        _GROUP_OF.setdefault(_w, 0)
        _GROUP_OF[_w] |= 1 << _k


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    marks: int
    children: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[str]
    links: list[int]  # characters within links of each block
    owner: list[int]


def _script_end(html: str, at: int) -> int:
    """Where the closing tag of a script is. A script within a comment within the script has a closing tag of its own; if that leaves
    the script open, the first closing tag ends it."""
    first, state = -1, 0  # 0 plain, 1 in a comment, 2 in a script of the comment
    for m in _SCRIPT_STATE.finditer(html, at):
        if m[0] == "<!--":
            # "<!-->" and "<!--->" are whole comments.
            state = state or (0 if html.startswith((">", "->"), m.end()) else 1)
        elif m[0] == "-->":
            state = 0
        elif not m[1]:
            state = 2 if state == 1 else state
        else:
            first = m.start() if first < 0 else first
            if state < 2:
                return m.start()
            state = 1
    return first


class _Ends:
    """Where elements end; a name that was looked for in vain is not looked for again."""

    def __init__(self, html: str) -> None:
        self.html, self.patterns, self.none = html, {}, set()

    def raw(self, name: str, at: int) -> int:
        if name in self.none:
            return -1
        if name == "script":
            end = _script_end(self.html, at)
        else:
            pattern = self.patterns.setdefault(name, re.compile(rf"</{name}(?=[\s/>])", re.I | re.A))
            m = pattern.search(self.html, at)
            end = m.start() if m else -1
        if end < 0:
            self.none.add(name)
        return end

    def nested(self, name: str, at: int) -> int:
        """As ``raw``, past elements of the same name inside."""
        pattern, depth = self.patterns.setdefault(("", name), re.compile(rf"<(/?){name}(?=[\s/>])", re.I | re.A)), 1
        if ("", name) in self.none:
            return -1
        for m in pattern.finditer(self.html, at):
            depth += -1 if m[1] else 1
            if not depth:
                return m.start()
        self.none.add(("", name))
        return -1


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes), ("close", name, "") and ("raw", name, content) in order; names in lower case.

    Character references stand as they are. What a left-out element holds is not read.
    """
    at, start, n, ends = 0, 0, len(html), _Ends(html)
    while True:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= n:
            break
        c = html[lt + 1]
        if c.isascii() and c.isalpha():
            m = _OPEN.match(html, lt)
            if lt > start:
                yield "text", html[start:lt], ""
            if m is None:  # the page ends within a tag
                return
            name, at = m[1].lower(), m.end()
            yield "open", name, m[2]
            if name in RAW or name in LEFT_OUT:
                if not (m[2] and _EMPTY_ELEMENT.search(m[2])):
                    end = ends.raw(name, at) if name in RAW else ends.nested(name, at)
                    if end < 0 and name in ("script", "style"):
                        end = n
                    if end >= 0:
                        if name in RAW:
                            yield "raw", name, html[at:end]
                        at = end
            start = at
        elif c == "/" and lt + 2 < n and html[lt + 2].isascii() and html[lt + 2].isalpha():
            m = _CLOSE.match(html, lt)
            if lt > start:
                yield "text", html[start:lt], ""
            if m is None:
                return
            yield "close", m[1].lower(), ""
            start = at = m.end()
        elif c in "!?" or (c == "/" and lt + 2 < n):
            if lt > start:
                yield "text", html[start:lt], ""
            if html.startswith("<!--", lt):
                if html.startswith((">", "->"), lt + 4):
                    start = at = html.index(">", lt) + 1
                    continue
                m = _COMMENT_END.search(html, lt + 4)
                end = m.end() if m else 0
            elif html.startswith("<![CDATA[", lt):
                end = html.find("]]>", lt) + 3
                end = n if end < 3 else end
                yield "text", html[lt + 9 : end].removesuffix("]]>").replace("&", "&amp;"), ""
            else:
                end = html.find(">", lt) + 1
            if not end:  # a comment that nothing closes
                return
            start = at = end
        else:
            at = lt + 1
    if start < n:
        yield "text", html[start:], ""


def parse(html: str, labels: list[bool] | None = None) -> Page:
    """The tree of a page. ``labels`` gets, for each node after the first, whether the generator of layouts marked it."""
    nodes = [Node("body", -1, 0, 0)]
    page = Page(nodes, [], [], [])
    stack, parts, linked, in_link, in_head = [0], [], 0, 0, False

    def text(s: str) -> None:
        nonlocal linked
        if "&" in s:
            s = _html.unescape(s)
        parts.append(s)
        if in_link:
            linked += len(s)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            block = " ".join("".join(parts).split())
            if block:
                nodes[stack[-1]].blocks.append(len(page.blocks))
                page.blocks.append(block)
                page.links.append(min(linked, len(block)))
                page.owner.append(stack[-1])
        parts, linked = [], 0

    def close(names: tuple[str, ...], within: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in names:
                del stack[k:]
                return
            if tag in within:
                return

    for kind, name, more in tokens(html):
        if kind == "text":
            if in_head and not name.strip():
                continue
            in_head = False
            text(name)
        elif kind == "raw":
            if name == "xmp" and not in_head:
                text(more.replace("&", "&amp;"))
        elif name == "head":
            in_head = kind == "open"
        elif name == "a":
            in_link = int(kind == "open")
        elif name in ("br", "select", "textarea"):
            text(" ")
        elif name == "hr":
            flush()
        elif name in _INDEX and name not in ("label", "button"):
            if in_head and name == "noscript":
                continue
            in_head = False
            flush()
            if kind == "close":
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == name:
                        del stack[k:]
                        in_link = 0
                        break
                continue
            if name == "body":
                nodes[0].marks |= _marks(more)
                continue
            if nodes[stack[-1]].tag == "p":
                stack.pop()
            if name in _CLOSES:
                close(_CLOSES[name], _CONTAINERS)
            if name[0] == "h" and name[1:].isdigit() and nodes[stack[-1]].tag[0] == "h" and nodes[stack[-1]].tag[1:].isdigit():
                stack.pop()
            nodes.append(Node(name, stack[-1], len(stack), _marks(more)))
            nodes[stack[-1]].children.append(len(nodes) - 1)
            stack.append(len(nodes) - 1)
            if labels is not None:
                labels.append(_KEPT in more)
    flush()
    return page


def _marks(attributes: str) -> int:
    marks = 0
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            if m[1].lower() in ("class", "id", "role"):
                for w in _TOKEN.findall((m[2] or m[3] or m[4] or "").lower()):
                    marks |= _GROUP_OF.get(w, 0)
    return marks


_TAG_GROUPS = (("main",), ("article",), ("section",), ("div",), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "legend", "search", "dialog"), ("p", "blockquote", "pre"), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "thead", "tbody", "tr", "td", "th", "tfoot", "caption"), ("figure", "figcaption"), ("body",))
_TAG_GROUP = {t: i for i, g in enumerate(_TAG_GROUPS) for t in g}
_UNKNOWN_GROUP = len(_TAG_GROUPS)


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(nodes x features, characters directly in each node)."""
    nodes, n = page.nodes, len(page.nodes)
    own, links, count, stops, paragraphs, inside = (np.zeros(n) for _ in range(6))
    for block, link, owner in zip(page.blocks, page.links, page.owner, strict=True):
        own[owner] += len(block)
        links[owner] += link
        count[owner] += 1
        stops[owner] += block.count(".") + block.count(",")
    direct = own.copy()
    tag = np.array([_TAG_GROUP.get(x.tag, _UNKNOWN_GROUP) for x in nodes])
    inside += 1
    paragraphs += tag == 9
    parent = np.array([x.parent for x in nodes])
    for k in range(n - 1, 0, -1):  # children follow their parents
        p = parent[k]
        own[p] += own[k]
        links[p] += links[k]
        count[p] += count[k]
        stops[p] += stops[k]
        paragraphs[p] += paragraphs[k]
        inside[p] += inside[k]
    marks = np.array([x.marks for x in nodes])
    above_marks, above_tags, sibling, siblings, alike, around = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.ones(n), np.ones(n), np.zeros(n)
    for k in range(1, n):
        p = parent[k]
        above_marks[k] = above_marks[p] | marks[p]
        above_tags[k] = above_tags[p] | (1 << int(tag[p]))
    for x in nodes:
        if x.children:
            c = np.array(x.children)
            sibling[c] = np.arange(len(c)) / len(c)
            siblings[c] = len(c)
            around[c] = own[c].mean()
            kinds = tag[c]
            alike[c] = (kinds[:, None] == kinds[None, :]).mean(1) if len(c) <= 64 else np.bincount(kinds, minlength=_UNKNOWN_GROUP + 1)[kinds] / len(c)
    total = max(1.0, own[0])
    size = np.maximum(own, 1)
    columns = [tag == g for g in range(_UNKNOWN_GROUP + 1)]
    columns += [(marks >> g) & 1 for g in range(len(GROUPS))]
    columns += [(above_marks >> g) & 1 for g in range(len(GROUPS))]
    columns += [(above_tags >> g) & 1 for g in range(_UNKNOWN_GROUP)]
    columns += [np.log1p(direct), np.log1p(own), own / total, links / size, own / inside, stops / size, own / np.maximum(count, 1), paragraphs, np.log1p(paragraphs), np.array([x.depth for x in nodes]), sibling, siblings, alike, np.log1p(around), np.arange(n) / n]
    return np.stack(columns, 1).astype(np.float32), direct


def decode(page: Page, log_odds: np.ndarray, direct: np.ndarray) -> np.ndarray:
    """Whether each node is kept."""
    n = len(page.nodes)
    weight = np.where(direct > 0, 0.25 + np.log1p(direct) / 4, 0.25)
    gain = np.clip(log_odds, -8, 8) * weight
    outside, inside = np.zeros(n), np.zeros(n)
    below_out, below_in = np.zeros(n), np.zeros(n)
    enters, drops = np.zeros(n, bool), np.zeros(n, bool)
    for k in range(n - 1, -1, -1):
        kept = gain[k] + below_in[k]
        drops[k] = -LEAVE > kept
        inside[k] = max(kept, -LEAVE)
        enters[k] = kept - ENTER > below_out[k]
        outside[k] = max(kept - ENTER, below_out[k])
        p = page.nodes[k].parent
        if p >= 0:
            below_out[p] += outside[k]
            below_in[p] += inside[k]
    state = np.zeros(n, np.int8)  # 0 outside, 1 kept, 2 dropped
    for k in range(n):
        p = page.nodes[k].parent
        above = state[p] if p >= 0 else 0
        state[k] = 2 if above == 2 else (2 if drops[k] else 1) if above == 1 else int(enters[k])
    return state == 1


class Layouts:
    """Makes labelled pages; a node is marked main by an attribute that the reader does not use."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, a: int, b: int, stop: bool = True) -> str:
        r = self.r
        out = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b))]
        for k in range(7, len(out), 9):
            out[k] += r.choice((",", "."))
        return " ".join(out).capitalize() + ("." if stop else "")

    def cls(self, group: str) -> str:
        r = self.r
        word = r.choice(GROUPS[group])
        form = r.choice(("{}", "{}-box", "site-{}", "{}s", "{} wide", "js-{}", "block-{}"))
        return r.choice((' class="{}"', ' id="{}"', ' class="x {}"')).format(form.format(word)) if r.random() < 0.85 else ""

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/x">{self.words(1, 3, False)}</a></li>' for _ in range(n))

    def noise(self) -> str:
        r = self.r
        kind = r.randrange(12)
        if kind == 0:
            return f"<nav{self.cls('menu')}><ul>{self.links(r.randint(2, 9))}</ul></nav>"
        if kind == 1:
            return f"<div{self.cls('ad')}>{self.words(2, 14)}</div>"
        if kind == 2:
            return f"<footer{self.cls('edge')}>&copy; {self.words(1, 3, False)} &middot; {self.words(2, 12)}</footer>"
        if kind == 3:
            return f"<header{self.cls('edge')}><div>{self.words(1, 4, False)}</div><p>{self.words(3, 8)}</p></header>"
        if kind == 4:
            return f"<aside{self.cls('side')}><h3>{self.words(1, 3, False)}</h3>" + "".join(f"<p>{self.words(5, 30)}</p>" for _ in range(r.randint(1, 3))) + "</aside>"
        if kind == 5:
            return f"<div{self.cls('notice')}><p>{self.words(6, 30)}</p><button>{self.words(1, 1, False)}</button></div>"
        if kind == 6:
            return f"<form{self.cls('notice')}><p>{self.words(3, 12)}</p><label>{self.words(1, 2, False)}</label><input></form>"
        if kind == 7:
            tag = r.choice(("div", "section", "ul", "ol"))
            item = "li" if tag in ("ul", "ol") else "div"
            return f'<{tag} class="{r.choice(("comments", "comment-list", "replies", "discussion"))}"><h3>{self.words(1, 2, False)}</h3>' + "".join(f'<{item} class="{r.choice(("comment", "reply"))}"><p>{self.words(4, 60)}</p></{item}>' for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if kind == 8:
            return f"<div{self.cls('side')}><h4>{self.words(1, 3, False)}</h4><ul>{self.links(r.randint(2, 6))}</ul></div>"
        if kind == 9:
            return f'<div class="{r.choice(("share", "social", "tags", "sharing"))}"><ul>{self.links(r.randint(2, 5))}</ul></div>'
        if kind == 10:
            return f'<div class="{r.choice(("sidebar", "widget", "related", "trending"))}"><p>{self.words(8, 40)}</p><p>{self.words(8, 40)}</p></div>'
        return f'<div class="{r.choice(("breadcrumb", "pagination", "pager"))}"><a href="/">{self.words(1, 1, False)}</a> <a href="/y">{self.words(1, 2, False)}</a></div>'

    def main(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f'<h1 data-k="1">{self.words(2, 9, False)}</h1>')
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            x = r.random()
            if x < 0.75:
                out.append(f'<p data-k="1">{self.words(*r.choice(((1, 4), (2, 8), (3, 12), (12, 60), (40, 160))))}</p>')
            elif x < 0.82:
                out.append(f'<h2 data-k="1">{self.words(1, 6, False)}</h2>')
            elif x < 0.89:
                tag = r.choice(("ul", "ol"))
                out.append(f'<{tag} data-k="1">' + "".join(f'<li data-k="1">{self.words(2, 20)}</li>' for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif x < 0.93:
                out.append(f'<blockquote data-k="1"><p data-k="1">{self.words(8, 40)}</p></blockquote>')
            elif x < 0.96:
                out.append('<table data-k="1">' + "".join(f'<tr data-k="1"><td data-k="1">{self.words(1, 4, False)}</td><td data-k="1">{self.words(1, 6, False)}</td></tr>' for _ in range(r.randint(2, 4))) + "</table>")
            else:
                out.append(f'<div data-k="1">{self.words(15, 60)}</div>')
            if r.random() < 0.06:
                out.append(self.noise())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        mark = "" if tag in ("article", "main") and r.random() < 0.6 else self.cls("good")
        body = self.main() if r.random() < 0.1 else f'<{tag}{mark} data-k="1">{self.main()}</{tag}>'
        if r.random() < 0.5:
            wrap = r.choice(("main", "div", "div", "section"))
            body = f"<{wrap}{self.cls('good')}>" + (self.noise() if r.random() < 0.3 else "") + body + "".join(self.noise() for _ in range(r.choice((0, 0, 1, 2)))) + f"</{wrap}>"
        before = "".join(self.noise() for _ in range(r.randint(0, 4)))
        after = "".join(self.noise() for _ in range(r.randint(0, 4)))
        return f"<html><head><title>{self.words(2, 5)}</title></head><body>{before}{body}{after}</body></html>"


_KEPT = 'data-k="1"'
_fitted: list[boosting.Boosted] = []


def train(pages: int = TRAINING_PAGES, seed: int = 7) -> boosting.Boosted:
    """The trees, fitted on generated pages; made once in a process."""
    if pages == TRAINING_PAGES and seed == 7 and _fitted:
        return _fitted[0]
    make, xs, ys = Layouts(seed), [], []
    for _ in range(pages):
        truth: list[bool] = []
        x, _ = features(parse(make.page(), truth))
        xs.append(x)
        ys.append(np.array([False, *truth], float))
    model = boosting.fit(np.concatenate(xs), np.concatenate(ys))
    if pages == TRAINING_PAGES and seed == 7:
        _fitted.append(model)
    return model


def texts(pages: list[str | None], model: boosting.Boosted) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p) if p else None for p in pages]
    rows = [features(p) if p is not None else None for p in parsed]
    have = [i for i, p in enumerate(parsed) if p is not None]
    if not have:
        return [""] * len(pages)
    odds = model.log_odds(np.concatenate([rows[i][0] for i in have]))
    out, at = [""] * len(pages), 0
    for i in have:
        page, n = parsed[i], len(parsed[i].nodes)
        kept = decode(page, odds[at : at + n], rows[i][1])
        at += n
        out[i] = "\n\n".join(b for b, o in zip(page.blocks, page.owner, strict=True) if kept[o])
    return out


def extract(pages: DataFrame, out: str = "main_text", batch_bytes: int = 2 << 20) -> DataFrame:
    """``pages`` (with ``html``) and the main text in ``out``. A column that is already named ``out`` raises ValueError."""
    if out in pages.columns:
        raise ValueError(f"pages already have a column {out}")
    model = pages.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[tuple[pa.Array]]) -> Iterator[pa.Array]:
        for (column,) in batches:
            found, group, held = [], [], 0
            for h in column:
                h = h.as_py()
                group.append(h)
                held += len(h or "")
                if held >= batch_bytes:
                    found += texts(group, model.value)
                    group, held = [], 0
            found += texts(group, model.value) if group else []
            yield pa.array(found, pa.string())

    return pages.withColumn(out, arrow_column(pages.sparkSession, run, "string", F.col("html").cast("string")))
