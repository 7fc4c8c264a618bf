"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of elements. Each element gets features of itself (tag,
words in its attributes, depth), of its subtree (text, links, element counts and
their densities), of its siblings and of its ancestors. Boosted trees give it
probabilities of three roles: PATH (a frame around content), CONTENT and OUT.
Decoding takes the best roles of all elements together by dynamic programming
over the tree, where below OUT all is OUT and below CONTENT nothing is PATH, so
no element contradicts its ancestors or descendants.

The trees are trained in numpy on generated pages, whose roles are known.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PATH, CONTENT, OUT = 0, 1, 2
#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NEVER = frozenset("script style head title noscript template iframe textarea button select option svg object embed xmp noembed noframes datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements within a block: where they begin or end, the block goes on.
FLOWING = INLINE | {"br", "script", "style", "noscript", "template", "input", "button", "select", "option", "label", "svg", "path", "object", "embed", "iframe", "textarea"}
#: Elements that an opening tag of a kind closes, up to the stopping elements.
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th", "thead", "tbody"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "body": ()}

#: Words in class, id, role and other attributes, by what they say.
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pager pagination toc",
    "edge": "header masthead footer foot banner colophon copyright bottom top contentinfo",
    "side": "sidebar side aside complementary widget rail related recommended trending more popular",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsense dfp outbrain taboola",
    "notice": "cookie cookies consent notice gdpr alert modal popup overlay banner message warning disclaimer",
    "comment": "comment comments commentlist reply replies respond discussion disqus reader",
    "form": "form login signin signup search newsletter subscribe subscription register",
    "social": "share sharing social follow tweet meta byline tags tag author",
    "good": "article content main story post entry body text page blog news prose richtext articlebody",
}
_CUE_OF = {w: k for k, ws in enumerate(CUES.values()) for w in ws.split()}
TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li a nav header footer aside form table tr td th thead tbody blockquote pre figure figcaption dl dt dd span b strong em i address details br img button label".split()
_TAG_CODE = {t: k + 1 for k, t in enumerate(TAGS)}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<([/!?])?([a-zA-Z][^\s/><]*)?((?:[^>\"'<]|\"[^\"]*\"|'[^']*')*+)>|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Page:
    """Elements in page order: tag, parent, cue counts; and texts with their elements."""

    def __init__(self, html: str):
        self.tag, self.parent, self.cues, self.depth, self.hidden = ["#"], [-1], [()], [0], [False]
        self.texts: list[tuple[int, str]] = []  # (element, text); None in place of text: the element opens or closes here
        self._parse(html)

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        cues, hidden = (), False
        if attributes and ("=" in attributes or "hidden" in attributes):
            found = []
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                value = a or b or c
                if name in ("class", "id", "role", "itemprop", "aria-label", "data-component", "data-testid"):
                    found += [_CUE_OF[w] for x in _NAME.findall(value) if (w := x.lower()) in _CUE_OF]
                elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and value == "true":
                    hidden = True
            cues = tuple(found)
        self.tag.append(tag)
        self.parent.append(parent)
        self.cues.append(cues)
        self.depth.append(self.depth[parent] + 1)
        self.hidden.append(hidden)
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        at, size = 0, len(html)
        tag, texts, find = self.tag, self.texts, _MARKUP.search
        open_, places = [0], {"#": [0]}  # elements that are open, and where in open_ those of each kind are
        texts.append((0, ""))

        def text(raw: str) -> None:
            if raw:
                texts.append((open_[-1], unescape(raw) if "&" in raw else raw))

        def close(until: int) -> None:
            while len(open_) > until:
                places[tag[open_.pop()]].pop()

        def imply(names: tuple, stops: tuple) -> None:
            """Closes the outermost open element of names above the nearest one of stops."""
            floor = max((places[x][-1] for x in stops if places.get(x)), default=0)
            found = [of[k] for x in names if (of := places.get(x)) and (k := bisect.bisect_right(of, floor)) < len(of)]
            if found:
                close(min(found))

        while at < size:
            m = find(html, at)
            if not m:
                text(html[at:])
                break
            mark, name = m[1], m[2]
            if m[0] == "<" or not name and not mark and not m[0].startswith("<!--"):
                text(html[at : m.start() + 1])  # a lone bracket is text
                at = m.start() + 1
                continue
            text(html[at : m.start()])
            at = m.end()
            if mark in ("!", "?") or not name:
                continue
            name = name.lower()
            if mark == "/":
                if places.get(name):
                    k = places[name][-1]
                    node = open_[k]
                    close(k)
                    texts.append((node, None))
                continue
            if name in _BLOCKS:
                imply(("p",), ("td", "th", "button", "table", "object"))
            elif name in _CLOSES:
                imply(_CLOSES[name], _HOLDS[name])
            node = self._open(name, open_[-1], m[3])
            texts.append((node, None))
            if name == "br":
                texts.append((open_[-1], " "))
            if name in VOID or m[3].endswith("/") and name in ("svg", "path", "use", "circle", "rect"):
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                at = size if end is None else html.find(">", end.end()) + 1 or size
                continue
            places.setdefault(name, []).append(len(open_))
            open_.append(node)


def features(page: Page) -> np.ndarray:
    """A row for each element of the page."""
    n = len(page.tag)
    parent = np.array(page.parent)
    depth = np.array(page.depth, float)
    own, blocks, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    before, seen = np.zeros(n), 0.0
    for node, t in page.texts:
        if t:
            size = len(t.strip())
            own[node] += size
            seen += size
            if size:
                stops[node] += t.count(". ") + t.count(", ") + t.endswith((".", "!", "?"))
        elif t is None and not before[node]:
            before[node] = seen
    tags = page.tag
    code = np.array([_TAG_CODE.get(t, 0) for t in tags], float)
    is_a = np.array([t == "a" for t in tags])
    link, paras, items, elements = np.where(is_a, own, 0.0), np.array([t == "p" for t in tags], float), np.array([t == "li" for t in tags], float), np.ones(n)
    anchors, inputs = is_a.astype(float), np.array([t in ("input", "button", "select", "textarea", "form", "label") for t in tags], float)
    total, marks = own.copy(), stops.copy()
    stack = [total, link, paras, items, elements, anchors, inputs, marks]
    table = np.stack(stack, 1)
    in_link = is_a.copy()
    for i in range(1, n):  # a link's text may be in elements inside it
        in_link[i] |= in_link[parent[i]]
    table[:, 1] = np.where(in_link, own, 0.0)
    for i in range(n - 1, 0, -1):
        table[parent[i]] += table[i]
    total, link, paras, items, elements, anchors, inputs, marks = table.T
    cues = np.zeros((n, len(CUES)))
    for i, c in enumerate(page.cues):
        for k in c:
            cues[i, k] += 1
    above = np.zeros((n, len(CUES)))
    inside = np.zeros((n, 6))  # below nav, header, footer, aside, form, article or main
    kinds = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 4, "article": 5, "main": 5}
    sibs, place = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        above[i] = above[p] + cues[p]
        inside[i] = inside[p]
        if tags[p] in kinds:
            inside[i, kinds[tags[p]]] += 1
        place[i] = sibs[p]
        sibs[p] += 1
    p = np.maximum(parent, 0)
    whole = max(1.0, total[0])
    out = [
        code, code[p], depth, np.log1p(total), np.log1p(own), link / np.maximum(1, total), total / np.maximum(1, elements), np.log1p(elements), np.log1p(paras), np.log1p(items), np.log1p(anchors), np.log1p(inputs),
        marks / np.maximum(1, total) * 100, total / whole, before / whole, sibs[p], place, place / np.maximum(1, sibs[p]), total / np.maximum(1, total[p]), (total[p] - total) / np.maximum(1, sibs[p] - 1), np.array(page.hidden, float), sibs,
        *inside.T,
    ]
    return np.column_stack([*out, *np.minimum(cues, 2).T, *np.minimum(above, 2).T])


class Boosted:
    """Softmax gradient boosting of small regression trees on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int = 3) -> Boosted:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        b = self.binned(x)
        self.prior = np.log((np.bincount(y, minlength=classes) + 1.0) / (n + classes))
        f, target = np.tile(self.prior, (n, 1)), np.eye(classes)[y]
        self.trees = []
        for _ in range(self.rounds):
            p = np.exp(f - f.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for c in range(classes):
                tree = self._grow(b, target[:, c] - p[:, c], p[:, c] * (1 - p[:, c]))
                self.trees.append(tree)
                f[:, c] += self._walk(tree, b)
        self.stack()
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def _grow(self, b, g, h):
        """Complete trees: feature and cut for inner nodes, values for leaves."""
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 32767, np.int16)
        at, m, width = np.zeros(len(b), np.int64), b.shape[1], self.bins + 1
        for level in range(self.depth):
            first = 2**level - 1
            for node in range(first, 2 * first + 1):
                rows = np.flatnonzero(at == node)
                if len(rows) >= 8:
                    flat = (b[rows] + np.arange(m) * width).ravel()
                    gs = np.bincount(flat, np.repeat(g[rows], m), m * width).reshape(m, width).cumsum(1)
                    hs = np.bincount(flat, np.repeat(h[rows], m), m * width).reshape(m, width).cumsum(1)
                    G, H = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                    gain[(hs < 0.5) | (H - hs < 0.5)] = 0
                    j, k = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, k] > 1e-4:
                        feature[node], cut[node] = j, k
                at[rows] = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        leaf = at - inner
        value = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        return feature, cut, value * self.rate

    def _walk(self, tree, b):
        feature, cut, value = tree
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return value[at - (2**self.depth - 1)]

    def stack(self):
        self.feature = np.stack([t[0] for t in self.trees])
        self.cut = np.stack([t[1] for t in self.trees])
        self.value = np.stack([t[2] for t in self.trees])

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        b, k = self.binned(x), len(self.prior)
        # elements with equal bins get equal answers, and pages of one site are full of those
        b, back = np.unique(b, axis=0, return_inverse=True)
        at, rows, trees = np.zeros((len(b), len(self.trees)), np.int64), np.arange(len(b))[:, None], np.arange(len(self.trees))[None, :]
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[rows, self.feature[trees, at]] > self.cut[trees, at])
        votes = self.value[trees, at - (2**self.depth - 1)]
        f = self.prior + votes.reshape(len(b), -1, k).sum(1)
        f -= f.max(1, keepdims=True)
        return (f - np.log(np.exp(f).sum(1, keepdims=True)))[back.ravel()]


#: Which roles a child may have below each role.
_BELOW = {PATH: (PATH, CONTENT, OUT), CONTENT: (CONTENT, OUT), OUT: (OUT,)}


def decode(page: Page, logs: np.ndarray) -> list[int]:
    """The likeliest roles of all elements under the rules of _BELOW; the root is PATH, or CONTENT where text stands by itself."""
    n, tags, parent = len(page.tag), page.tag, page.parent
    score = np.maximum(logs, -12.0).tolist()
    for i in range(n):
        if tags[i] in NEVER or page.hidden[i]:
            score[i] = [-1e6, -1e6, 0.0]
    for i in range(n - 1, 0, -1):
        s, (p, c, o) = score[parent[i]], score[i]
        s[PATH] += max(p, c, o)
        s[CONTENT] += max(c, o)
        s[OUT] += o
    role = [PATH if score[0][PATH] >= score[0][CONTENT] else CONTENT] * n
    for i in range(1, n):
        s = score[i]
        role[i] = max(_BELOW[role[parent[i]]], key=lambda r: s[r])
    return role


def text_of(page: Page, role: list[int]) -> str:
    """The blocks of the CONTENT elements, one a line."""
    blocks, held = [], []
    tags = page.tag

    def cut() -> None:
        if held:
            t = _SPACE.sub(" ", "".join(held)).strip()
            if t:
                blocks.append(t)
            held.clear()

    for node, t in page.texts:
        if t is None:
            if tags[node] not in FLOWING:
                cut()
        elif t and role[node] == CONTENT:
            held.append(t)
    cut()
    return "\n".join(blocks)


def generated(n: int, seed: int = 11) -> list[tuple[str, dict[str, int]]]:
    """Pages whose elements carry their role in an attribute, of many layouts.

    The first role, in a comment, is the root's. Layouts are semantic elements,
    boxes with telling names or with none, tables, and text that stands in the
    body or in nothing at all.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou", "es", "ti", "la", "que")) for _ in range(r.randint(1, 4)))
    words = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))
    sentence = lambda: words(3, 18).capitalize() + r.choice((".", ".", ".", "!", "?"))
    text = lambda lo, hi: " ".join(sentence() for _ in range(r.randint(lo, hi)))
    attr = lambda cls: r.choice((f' class="{cls}"', f' id="{cls}"', f' class="{word()} {cls}"', f' class="{cls} {word()}"', f' role="{cls}"'))
    plain = lambda: r.choice(("", "", f' class="{word()}"', f' id="{word()}"', ' class="wrapper"', ' class="container row"'))

    def el(tag, role, inner, attributes=""):
        return f'<{tag} y="{role}"{attributes}>{inner}</{tag}>'

    def cue(*kinds):
        return attr(r.choice([w for k in kinds for w in CUES[k].split()]))

    def links(role, lo=2, hi=9):
        one = lambda: el("a", role, words(1, 3), ' href="/x"')
        form = r.choice(("ul", "ul", "div", "span", "bare"))
        if form == "ul":
            return el("ul", role, "".join(el("li", role, one()) for _ in range(r.randint(lo, hi))))
        if form == "bare":
            return r.choice((" | ", " ", " &middot; ")).join(one() for _ in range(r.randint(lo, hi)))
        return "".join(el(form, role, one()) + " " for _ in range(r.randint(lo, hi)))

    def paragraph(role=CONTENT, tag="p"):
        inner = text(*r.choice(((1, 1), (1, 1), (2, 2), (4, 4), (9, 9)))) if r.random() < 0.85 else words(1, 2).capitalize() + r.choice((".", ".", "!", ""))
        if r.random() < 0.3:
            inner = f"{sentence()} {el(r.choice(('b', 'i', 'em', 'a', 'strong', 'span', 'code')), role, words(1, 9))} {inner}"
        if tag == "p" and r.random() < 0.12:
            return f'<p y="{role}"><b y="{role}">{inner}<br y="{role}">'
        return el(tag, role, inner, plain() if tag != "p" or r.random() < 0.1 else "")

    def form():
        return el("form", OUT, r.choice(("", el("label", OUT, words(1, 3)))) + f'<input y="{OUT}">' + el("button", OUT, words(1, 1)), r.choice(("", cue("form"))))

    def junk():
        k = r.randrange(10)
        if k == 0:
            return el(r.choice(("nav", "div", "nav", "p")), OUT, links(OUT), r.choice(("", cue("menu"))))
        if k == 1:
            return el("div", OUT, r.choice((sentence(), sentence() + links(OUT, 1, 3), el("p", OUT, sentence()))), cue("advert"))
        if k == 2:
            return el(r.choice(("aside", "div")), OUT, el("h3", OUT, words(1, 4)) + r.choice((links(OUT), el("p", OUT, sentence()))), cue("side"))
        if k == 3:
            return el("div", OUT, el("p", OUT, sentence()) + el("button", OUT, words(1, 2)), r.choice((cue("notice"), cue("notice"), plain())))
        if k == 4:
            return form()
        if k == 5:
            many = "".join(el(r.choice(("div", "li")), OUT, el("b", OUT, word()) + el("p", OUT, text(1, 3)), r.choice(("", cue("comment")))) for _ in range(r.randint(1, 6)))
            return el(r.choice(("section", "div", "ol")), OUT, el("h3", OUT, words(1, 2)) + many, cue("comment"))
        if k == 6:
            return el("div", OUT, links(OUT, 2, 5), r.choice((cue("social"), plain())))
        if k == 7:
            return el("header", OUT, r.choice((el("h1", OUT, words(1, 3)), el("div", OUT, words(1, 4)))) + r.choice(("", links(OUT))), r.choice(("", cue("edge"))))
        if k == 8:
            return box()
        return el(r.choice(("footer", "footer", "div")), OUT, f"&copy; {words(1, 3)} &middot; {sentence()}" + r.choice(("", links(OUT))), cue("edge") if r.random() < 0.5 else ' class="footer"')

    def box():
        """What asks the reader to sign up or to go elsewhere, inside an article too."""
        ask = r.choice((el("p", OUT, sentence()), el("h3", OUT, words(1, 4)), sentence(), el("h4", OUT, words(1, 3)) + el("p", OUT, sentence())))
        return el(r.choice(("div", "div", "aside", "section")), OUT, ask + r.choice((form(), form(), f'<input y="{OUT}">' + el("button", OUT, word()), links(OUT, 2, 5))), r.choice((cue("form", "social", "side"), cue("form"), plain())))

    def content(tag="p", headed=True):
        parts = [el(r.choice(("h1", "h1", "h2")), CONTENT, words(2, 9))] if headed and r.random() < 0.85 else []
        if parts and r.random() < 0.35:  # an article's own header
            under = r.choice(("", el("p", CONTENT, sentence()), el(r.choice(("div", "p", "span")), OUT, words(2, 5), cue("social"))))
            parts = [el("header", CONTENT, parts[0] + under, plain())]
        for _ in range(r.choice((0, 1, 2, 4, 8, 16))):
            k = r.random()
            if k < 0.72:
                parts.append(paragraph(tag=tag))
            elif k < 0.8:
                parts.append(el(r.choice(("h2", "h3")), CONTENT, words(1, 6)))
            elif k < 0.86:
                parts.append(el(r.choice(("ul", "ol")), CONTENT, "".join(el("li", CONTENT, sentence()) for _ in range(r.randint(2, 5)))))
            elif k < 0.89:
                parts.append(el("blockquote", CONTENT, r.choice((sentence(), el("p", CONTENT, sentence())))))
            elif k < 0.92:
                parts.append(el("table", CONTENT, "".join(el("tr", CONTENT, "".join(el("td", CONTENT, words(1, 4)) for _ in range(3))) for _ in range(r.randint(2, 4)))))
            elif k < 0.94:
                parts.append(el("pre", CONTENT, words(4, 20)))
            elif k < 0.97:
                parts.append(junk() if r.random() < 0.6 else box())
            else:
                parts.append(el("figure", CONTENT, el("figcaption", CONTENT, sentence())))
        return "".join(parts) or paragraph(tag=tag)

    def bare():
        """Text of an article without elements of its own."""
        return f' <br y="{CONTENT}">'.join(text(1, 6) if r.random() < 0.8 else f"{sentence()} {el(r.choice(('b', 'i', 'a')), CONTENT, words(1, 4))} {sentence()}" for _ in range(r.choice((1, 2, 3, 6))))

    def menu(tag="div"):
        return el(tag, OUT, links(OUT, 3, 9), plain())

    def around(inner, most=2):
        """inner in frames, with other things beside it."""
        for _ in range(r.randint(0, most)):
            inner = el(r.choice(("div", "div", "main", "section")), PATH, "".join(junk() for _ in range(r.choice((0, 0, 1)))) + inner + "".join(junk() for _ in range(r.choice((0, 0, 1)))), plain())
        return inner

    out = []
    for _ in range(n):
        layout, root, body = r.random(), PATH, PATH
        if layout < 0.55:
            tag = r.choice(("article", "article", "article", "main", "div", "section"))
            hint = cue("good") if tag in ("div", "section") or r.random() < 0.3 else ""
            inner = around(el(tag, CONTENT, content(), hint))
            above = [el(r.choice(("nav", "nav", "div")), OUT, links(OUT), r.choice(("", ' class="menu"')))] if r.random() < 0.6 else []
            above += [junk() for _ in range(r.choice((0, 1, 2)))]
            below = [junk() for _ in range(r.choice((0, 1, 2, 3)))]
            if r.random() < 0.6:
                below.append(el("footer", OUT, f"&copy; {words(1, 2)} &middot; {sentence()}"))
            inner = "".join([*above, inner, *below])
        elif layout < 0.72:  # boxes that say nothing of themselves
            inner = around(el("div", CONTENT, content(r.choice(("p", "p", "div"))), plain()), 1)
            inner = r.choice(("", menu())) + inner + "".join(menu() for _ in range(r.choice((0, 1, 2)))) + r.choice(("", el("div", OUT, f"&copy; {words(1, 3)}", plain())))
        elif layout < 0.8:  # a table as a page
            cells = el("td", OUT, links(OUT, 3, 9), plain()), el("td", CONTENT, content(), plain())
            inner = r.choice(("", menu())) + el("table", PATH, el("tr", PATH, "".join(cells if r.random() < 0.7 else cells[::-1]), plain()), plain())
        elif layout < 0.9:  # paragraphs, or bare text, among the body's other elements
            body = CONTENT
            inner = r.choice(("", menu(), menu("nav"))) + r.choice((content(), bare(), content(headed=False))) + r.choice(("", menu(), junk()))
        else:  # no document around it
            root, body = CONTENT, None
            inner = r.choice((bare(), bare(), content(), paragraph() + bare()))
        if body is not None:
            inner = f'<!DOCTYPE html><html y="{body}"><head y="{OUT}"><title>{words(2, 6)}</title></head><body y="{body}">{inner}</body></html>'
            root = body
        out.append(f'<!-- y="{root}"-->{inner}')
    return out


_ROLE = re.compile(r' y="(\d)"')


@functools.cache
def trained(pages: int = 1200) -> Boosted:
    """The trees, from generated pages."""
    xs, ys = [], []
    for marked in generated(pages):
        page = Page(_ROLE.sub("", marked))
        xs.append(features(page))
        roles = [int(m[1]) for m in _ROLE.finditer(marked)]
        it = iter(roles)
        ys.append([OUT if t == "title" else next(it) for t in page.tag])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def main_texts(htmls: list[str], model: Boosted) -> list[str]:
    pages = [Page(h) for h in htmls]
    rows = [features(p) for p in pages]
    logs = model.log_probabilities(np.concatenate(rows)) if rows else None
    out, at = [], 0
    for page, x in zip(pages, rows, strict=True):
        out.append(text_of(page, decode(page, logs[at : at + len(x)])))
        at += len(x)
    return out


def _extract(sent):
    def rows(given):
        model, held, size = sent.value, [], 0
        for row in given:
            held.append(row)
            size += len(row[2])
            if size >= 500_000:
                yield from ((i, u, t) for (i, u, _), t in zip(held, main_texts([h for _, _, h in held], model), strict=True))
                held, size = [], 0
        yield from ((i, u, t) for (i, u, _), t in zip(held, main_texts([h for _, _, h in held], model), strict=True))

    return rows


def extract(pages: DataFrame) -> DataFrame:
    """Returns page_id, url and text, a row for each row of pages.

    Null or empty html, or a page without main text, gives an empty text. Null
    ids and URLs stay null. Rows that repeat are extracted each for itself.
    Other columns are ignored. An empty table gives an empty result.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trained())  # 120 trees of 16 leaves
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return common.arrow_pass(rows, _extract(sent), "page_id long, url string, text string", 512)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
