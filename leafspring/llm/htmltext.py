"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so
that the labels of ancestors and descendants never contradict each other."""

from __future__ import annotations

import html as html_lib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea template iframe noembed noframes".split())
TO_THE_END = set("script style title textarea".split())  # without an end tag the rest of the page is theirs
HEAD_ONLY = set("base basefont bgsound link meta script style template title".split())
FOREIGN = set("svg math".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q s samp small span strike strong sub sup time tt u var img wbr nobr ruby rt rp svg math".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE = set("html body table td th caption button object".split())
TAG_GROUPS = (
    "article main", "p", "h1 h2 h3 h4 h5 h6", "div section", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form button select input fieldset label option",
    "table tbody thead tr", "td th", "blockquote pre figure figcaption details", "body html", "a span",
)
ATTR_GROUPS = (
    "article content post story entry main body text prose blog maincontent articlebody",
    "ad ads advert adverts advertisement advertising sponsor sponsored banner promo promoted promotion adsense dfp adslot",
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager topnav subnav toc tabs",
    "header masthead topbar head branding logo site",
    "footer foot bottom copyright legal colophon",
    "sidebar side aside widget widgets rail related recommended recommendations trending popular more teaser",
    "comment comments disqus reply replies respond discussion reviews feedback responses commentlist",
    "notice cookie cookies consent alert gdpr modal popup overlay dialog disclaimer warning toast message",
    "form search login signup newsletter subscribe subscription register signin contact",
    "share sharing social follow tools toolbar actions meta byline tags",
)
_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_ATTR = {t: i for i, g in enumerate(ATTR_GROUPS) for t in g.split()}
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
PASS, MAIN, OUT = 0, 1, 2


class Page:
    """Nodes of a page that can be labelled (blocks, and inline elements with a
    class, id or role) and its text runs, in page order: runs holds (node, text),
    with None as text where a block begins or ends."""

    def __init__(self, source: str):
        self.tag, self.parent, self.groups = ["html"], [-1], [set()]
        self.link, self.runs = [], []
        self.stack = [("html", 0, False)]  # tag, node, inline
        self._parse(source)

    def _open(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            self._close("p", SCOPE)
        if tag == "li":
            self._close("li", SCOPE | {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            self._close("dt", SCOPE | {"dl"}), self._close("dd", SCOPE | {"dl"})
        elif tag == "tr":
            self._close("tr", {"table", "html"})
        elif tag in ("td", "th"):
            self._close("td", {"tr", "table", "html"}), self._close("th", {"tr", "table", "html"})
        elif tag == "option":
            self._close("option", {"select", "html"})
        elif tag == "body":
            self._close("head", {"html"})
        at = self.stack[-1][1]
        inline = tag in INLINE or self._foreign()
        if not inline:
            self.runs.append((at, None, False))
        if tag in VOID:
            return
        found = set()
        if attrs and tag != "a" and "=" in attrs:
            for m in _NAMED.finditer(attrs):
                found |= {_ATTR[w] for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()) if w in _ATTR}
        if not inline or found:
            self.tag.append(tag), self.parent.append(at), self.groups.append(found)
            at = len(self.tag) - 1
        self.stack.append((tag, at, inline))

    def _close(self, tag: str, stop=frozenset(("html",))) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name == tag:
                if not all(inline for _, _, inline in self.stack[i:]):
                    self.runs.append((self.stack[i][1], None, False))
                del self.stack[i:]
                return
            if name in stop:
                return

    def _foreign(self) -> bool:
        return any(t in FOREIGN for t, _, _ in self.stack)

    def _in_body(self) -> None:
        """The ends of the head and the start of the body, where left out."""
        if self.stack[-1][0] == "head" or len(self.stack) == 1:
            self._open("body", "")

    def _text(self, text: str) -> None:
        self.runs.append((self.stack[-1][1], text, any(t == "a" for t, _, _ in self.stack)))

    def _parse(self, source: str) -> None:
        """Tags may be left out as HTML allows (head, body, p, li, ...); an end tag
        of the body or the page changes nothing. Text of script, style, title and
        textarea is no text, and goes on to the end of the page without an end
        tag; template and iframe without one are passed over alone."""
        at, lower = 0, None
        while True:
            m = _PIECE.search(source, at)
            text = source[at : m.start() if m else len(source)]
            if text and text.strip():
                self._in_body()
            if text and self.stack[-1][0] != "head":
                self._text(html_lib.unescape(text))
            if not m:
                return
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            in_head = self.stack[-1][0] == "head"
            if m[1]:
                if tag not in ("body", "html"):
                    self._close(tag)
            elif tag in RAW or tag == "xmp" or tag == "noscript" and in_head:
                lower = lower or source.lower()
                end = lower.find(f"</{tag}", at)
                if tag == "xmp":  # shown as it is written
                    self._in_body()
                    self._open("pre", m[3])
                    self._text(source[at : end if end >= 0 else len(source)])
                    self._close("pre")
                if end >= 0:
                    at = source.find(">", end) + 1 or len(source)
                elif tag in TO_THE_END or tag == "xmp":
                    return
            elif tag == "head":
                if len(self.stack) == 1 and "body" not in self.tag:
                    self._open(tag, m[3])
            elif tag == "body":
                if "body" not in self.tag:
                    self._open(tag, m[3])
            elif tag != "html":
                if tag not in HEAD_ONLY:
                    self._in_body()
                self._open(tag, m[3])
                if m[3].endswith("/") and tag not in VOID and self._foreign():
                    self._close(tag)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        own, linked, blocks, stops = [0] * n, [0] * n, [0] * n, [0] * n
        for at, text, link in self.runs:
            if text is not None:
                size = len(text.strip())
                own[at] += size
                linked[at] += size * link
                blocks[at] += size > 0
                stops[at] += text.count(".") + text.count(",")
        total, links, below, runs, marks, paras = own[:], linked[:], [1] * n, blocks[:], stops[:], [t == "p" for t in self.tag]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            total[p] += total[i]
            links[p] += links[i]
            below[p] += below[i]
            runs[p] += runs[i]
            marks[p] += marks[i]
            paras[p] += paras[i]
        depth, up, place, kids, before = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        seen = [0] * n
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            mask = up[p]
            for g in self.groups[p]:
                mask |= 1 << g
            if self.tag[p] in _TAG:
                mask |= 1 << (16 + _TAG[self.tag[p]])
            up[i] = mask
            place[i] = kids[p]
            kids[p] += 1
            before[i] = seen[p]
            seen[p] = total[i]
        t, lk, page = np.array(total, float), np.array(links, float), max(1, total[0])
        par = np.maximum(np.array(parent), 0)
        kid, pl = np.array(kids, float), np.array(place, float)
        ups = np.array(up)
        cols = [
            np.log1p(t), t / page, np.log1p(own), lk / np.maximum(t, 1), np.log1p(below), t / np.array(below), np.log1p(paras), t / np.maximum(runs, 1), np.array(marks) / np.maximum(t, 1),
            np.array(depth, float), pl, kid[par] - pl, t / np.maximum(t[par], 1), np.log1p(before), kid,
        ]
        tags = np.array([_TAG.get(x, -1) for x in self.tag])
        cols += [(tags == g).astype(float) for g in range(len(TAG_GROUPS))]
        cols += [np.array([g in x for x in self.groups], float) for g in range(len(ATTR_GROUPS))]
        cols += [(ups >> g & 1).astype(float) for g in range(len(ATTR_GROUPS))]
        cols += [(ups >> (16 + g) & 1).astype(float) for g in (0, 6, 7, 8, 9, 10)]
        return np.stack(cols, 1)

    def decode(self, logp: np.ndarray, change: float = 2.0, doubt: float = 6.0) -> np.ndarray:
        """The labelling of greatest total log-probability in which every path
        from the root is PASS*, then MAIN*, then OUT* (either part may be
        missing); leaving MAIN costs change. A labelling without MAIN gives way to
        the best one with it, if that costs at most doubt."""
        n = len(self.tag)
        best = logp.copy()
        best[0] = (0.0, -30.0, -30.0)
        choice = np.zeros((n, 3), np.int8)
        rows = best.tolist()
        picks = choice.tolist()
        for i in range(n - 1, 0, -1):
            a, b, c = rows[i]
            up = rows[self.parent[i]]
            k = max(((a, PASS), (b, MAIN), (c, OUT)), key=lambda x: x[0])
            up[PASS] += k[0]
            j = (b, MAIN) if b >= c - change else (c - change, OUT)
            up[MAIN] += j[0]
            up[OUT] += c
            picks[i] = [k[1], j[1], OUT]
        label = np.zeros(n, np.int8)
        for i in range(1, n):
            label[i] = picks[i][label[self.parent[i]]]
        if n > 1 and not (label == MAIN).any():
            top = [max(r) for r in rows]
            loss = [0.0] * n  # of PASS from the root down to a node
            for i in range(1, n):
                loss[i] = loss[self.parent[i]] + top[i] - rows[i][PASS]
            least, first = min((loss[self.parent[i]] + top[i] - rows[i][MAIN], i) for i in range(1, n))
            if least <= doubt:
                forced, i = {first: MAIN}, self.parent[first]
                while i > 0:
                    forced[i], i = PASS, self.parent[i]
                for i in range(1, n):
                    label[i] = forced.get(i, picks[i][label[self.parent[i]]])
        return label

    def text(self, label: np.ndarray) -> str:
        out = [" " if text is None else text for at, text, _ in self.runs if text is None or label[at] == MAIN]
        return " ".join("".join(out).split())


class Boosted:
    """Softmax gradient boosting with depth-limited histogram trees, in numpy.
    Every tree is a complete binary tree: feature and cut of inner node k are at
    k, its children at 2k + 1 and 2k + 2."""

    def __init__(self, classes: int = 3, rounds: int = 50, depth: int = 4, rate: float = 0.3, bins: int = 32):
        self.classes, self.rounds, self.depth, self.rate, self.bins = classes, rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        score = np.zeros((n, self.classes))
        inner, width = (1 << self.depth) - 1, self.bins
        flat = code + np.arange(f) * width
        real = np.arange(width) < np.array([len(c) for c in cuts])[:, None]  # bins that a cut ends
        self.trees = []
        for _ in range(self.rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for c in range(self.classes):
                g, h = weight * ((y == c) - p[:, c]), weight * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                feature, cut, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(n, int)
                for level in range(self.depth):
                    base, nodes = (1 << level) - 1, 1 << level
                    local = at - base
                    # all features' histograms at once: (node, feature, bin)
                    key = (local[:, None] * (f * width) + flat).ravel()
                    gs, hs = (np.bincount(key, np.repeat(v, f), nodes * f * width).reshape(nodes, f, width).cumsum(2) for v in (g, h))
                    gt, ht = gs[..., -1:], hs[..., -1:]
                    gains = np.where(real, gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1), -np.inf)
                    where, gain = gains.argmax(2), gains.max(2)
                    pick = gain.argmax(1)
                    for k in range(nodes):
                        j = pick[k]
                        if gain[k, j] > 1e-6:
                            feature[base + k], cut[base + k] = j, cuts[j][where[k, j]]
                    at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
                leaf = at - inner
                value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
                score[:, c] += value[leaf]
                self.trees.append((c, feature, cut, value))
        return self

    def log_proba(self, x: np.ndarray) -> np.ndarray:
        score, inner, rows = np.zeros((len(x), self.classes)), (1 << self.depth) - 1, np.arange(len(x))
        for c, feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            score[:, c] += value[at - inner]
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))


def sample_page(rng: np.random.Generator) -> str:
    """A made-up page for training, main text marked by data-m (a marker that is
    no feature). Layouts, element names and attribute tokens vary."""
    pick = lambda *x: x[rng.integers(len(x))]
    letters = np.array(list("etaoinshrdluéü"))

    def words(n):
        ends = rng.integers(2, 10, n).cumsum()
        line = "".join(letters[rng.integers(0, 14, ends[-1] if n else 0)].tolist())
        out = [line[a:z] for a, z in zip([0, *ends.tolist()[:-1]], ends.tolist(), strict=True)] if n else []
        for i in range(int(rng.integers(3, 12)), n, 9):
            out[i] += pick(".", ",")
        return " ".join(out).capitalize()

    def some(lo, hi):
        return words(int(rng.integers(lo, hi)))

    def attr(*tokens, chance=0.8):
        if rng.random() > chance:
            return ""
        token = pick(*tokens)
        return f' {pick("class", "id")}="{pick("", "", "x-", "c1 ")}{token}{pick("", "", "-box", " wide")}"'

    def para():
        body = some(1, 6) if rng.random() < 0.15 else some(8, 90)
        if rng.random() < 0.25:
            body = f"<b>{body}</b>" if rng.random() < 0.5 else f"<b>{body}<br>"
        if rng.random() < 0.15:
            body += f' <a href="/x">{some(1, 4)}</a> {some(2, 9)}'
        return f"<p>{body}" + ("</p>" if rng.random() < 0.9 else "")

    def links(n):
        items = "".join(f'<li><a href="/{i}">{some(1, 4)}</a></li>' for i in range(n))
        return f"<ul>{items}</ul>"

    def box(tag, inner, *tokens, chance=0.9):
        return f"<{tag}{attr(*tokens, chance=chance)}>{inner}</{tag}>"

    def ad():
        return box(pick("div", "div", "aside", "section"), pick(some(2, 20), f"<p>{some(4, 24)}</p>", f'<a href="/ad">{some(3, 9)}</a>'), "ad", "ads", "advert", "sponsored", "promo", "banner", chance=1.0)

    def nav():
        return pick(box("nav", links(int(rng.integers(3, 10))), "nav", "menu", chance=0.4), box("div", links(int(rng.integers(3, 10))), "navigation", "menu", "breadcrumb", "navbar", chance=1.0))

    def notice():
        return box(pick("div", "section", "aside"), pick(f"<p>{some(6, 40)}</p>", some(5, 30)) + pick("", f"<button>{some(1, 2)}</button>"), "notice", "cookie-consent", "alert", "disclaimer", "gdpr", chance=1.0)

    def form():
        return pick(f'<form action="/s"><label>{some(1, 4)}</label><input><button>{some(1, 3)}</button></form>', box("div", f"<p>{some(4, 16)}</p><form><input></form>", "newsletter", "subscribe", "search", chance=1.0))

    def comments():
        one = lambda: box("div", f"<p>{some(2, 50)}</p>" + pick("", f"<span>{some(1, 3)}</span>"), "comment", "reply", chance=0.6)
        return box(pick("div", "section", "ol"), f"<h3>{some(1, 4)}</h3>" + "".join(one() for _ in range(rng.integers(1, 7))), "comments", "discussion", "responses", "comment-list", chance=1.0)

    def aside():
        return pick(
            box("aside", f"<h3>{some(1, 4)}</h3>" + pick(links(4), f"<p>{some(4, 40)}</p>"), "sidebar", "widget", chance=0.5),
            box("div", f"<h4>{some(1, 4)}</h4>" + pick(links(5), f"<p>{some(4, 50)}</p>"), "sidebar", "related", "widget", "trending", chance=1.0),
        )

    def foot():
        inner = pick(f"&copy; {some(2, 12)}", f"<p>{some(2, 20)}</p>", links(4) + f"<p>{some(2, 12)}</p>")
        return pick(f"<footer>{inner}</footer>", box("div", inner, "footer", "copyright", "legal", chance=1.0))

    def head():
        return pick(f"<header><h1>{some(1, 5)}</h1>{nav()}</header>", box("header", f"<p>{some(1, 8)}</p>", "masthead", chance=0.3), box("div", f"<h2>{some(1, 5)}</h2><p>{some(2, 8)}</p>", "header", "masthead", "topbar", chance=1.0))

    def maybe(chance, make):
        return make() if rng.random() < chance else ""

    def bare():
        return f"{some(6, 60)}{pick('<br>', '<br><br>', ' <i>x</i> ')}{some(4, 60)}" + pick("", "<br>")

    outside = lambda x: x.replace("<", "<!--o--><", 1)
    main = [f"<h1>{some(2, 12)}</h1>"] if rng.random() < 0.8 else []
    loose = rng.random() < 0.12  # text without paragraphs
    for _ in range(int(rng.integers(0, 3) if rng.random() < 0.3 else rng.integers(2, 14))):
        r = rng.random()
        if r < 0.74:
            main.append(bare() if loose and rng.random() < 0.7 else para())
        elif r < 0.8:
            main.append(f"<h2>{some(1, 8)}</h2>")
        elif r < 0.84:
            main.append("<ul>" + "".join(f"<li>{some(2, 18)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
        elif r < 0.87:
            main.append(f"<blockquote>{pick(some(6, 40), '<p>' + some(6, 40) + '</p>')}</blockquote>")
        elif r < 0.9:
            main.append("<table>" + "".join(f"<tr><td>{some(1, 5)}</td><td>{some(1, 5)}</td></tr>" for _ in range(rng.integers(2, 5))) + "</table>")
        elif r < 0.92:
            main.append(f"<div>{para()}{para()}</div>")
        else:
            main.append(outside(pick(ad, form, notice, aside)()))
    if not main:
        main = [f"<h1>{some(2, 8)}</h1>"]
    if rng.random() < 0.04:
        main.append(pick("<svg class='icon'/>", "<svg><path d='M0'/></svg>", f"<math><mi>{some(1, 2)}</mi><mo>=</mo></math>", f"<noscript><img src='x'>{some(1, 8)}</noscript>"))
    inside = maybe(0.15, lambda: outside(comments()))
    shell = pick("article", "article", "article", "main", "div", "section")
    mark = "" if shell in ("article", "main") and rng.random() < 0.7 else attr("content", "post", "story", "article-body", "entry-content", "main-text", chance=0.95)
    body = f"<{shell}{mark} data-m>{''.join(main)}{inside}</{shell}>"
    if shell != "main" and rng.random() < 0.3:
        body = pick("<main>{}</main>", '<div class="wrapper">{}</div>', '<div id="page">{}</div>').format(maybe(0.3, ad) + body + maybe(0.3, aside) + maybe(0.3, comments))
    if rng.random() < 0.22:  # nothing around the text
        around = rng.random() < 0.7
        if rng.random() < 0.5:
            main = [pick(bare, bare, para)() for _ in range(rng.integers(1, 4))]
        sides = [[outside(part) for part in (maybe(c, make) for c, make in side) if part and around] for side in (
            ((0.4, head), (0.7, nav), (0.2, notice), (0.4, ad)), ((0.35, comments), (0.3, aside), (0.25, form), (0.2, ad), (0.7, foot)))]
        if rng.random() < 0.12:  # nor any text
            return f"<!DOCTYPE html><html><body>{''.join(sides[0])}{''.join(sides[1])}"
        return f"<!DOCTYPE html><html><head><title>{some(2, 8)}</title></head><body data-m>{''.join(sides[0])}{''.join(main) or bare()}{inside}{''.join(sides[1])}"

    def script():
        return f"<noscript><p>{some(3, 14)}</p></noscript>"

    parts = [maybe(0.05, script), maybe(0.5, head), maybe(0.75, nav), maybe(0.25, notice), maybe(0.5, ad), body, maybe(0.35, comments), maybe(0.35, aside), maybe(0.25, form), maybe(0.2, ad), maybe(0.75, foot), maybe(0.1, notice)]
    return f"<!DOCTYPE html><html><head><title>{some(2, 8)}</title><style>p{{}}</style></head><body>{''.join(parts)}" + pick("</body></html>", "")


_MARKED = re.compile(r" data-m(?=>)")


def truth(source: str) -> tuple[Page, np.ndarray]:
    """A training page's nodes and their labels."""
    source = source.replace("<!--o-->", "\x01")
    source = re.sub("\x01<([a-z]+)", r"<\1 data-o", source)
    page, marks = Page(""), []
    opened = page._open

    def spy(tag, attrs):
        before = len(page.tag)
        opened(tag, attrs.replace(" data-m", "").replace(" data-o", ""))
        if len(page.tag) > before:
            marks.append((before, "m" if " data-m" in attrs else "o" if " data-o" in attrs else ""))

    page._open = spy
    page._parse(source)
    label = np.full(len(page.tag), OUT)
    label[0] = PASS
    for at, mark in marks:
        up = label[page.parent[at]]
        label[at] = MAIN if mark == "m" or up == MAIN and mark != "o" else OUT
    for at in range(len(label) - 1, 0, -1):  # what contains the main text passes
        if label[at] in (MAIN, PASS) and label[page.parent[at]] == OUT:
            label[page.parent[at]] = PASS
    return page, label


@lru_cache(maxsize=2)
def trained(pages: int = 1500, seed: int = 7) -> Boosted:
    """The model, fitted on made-up pages (a fixed number, from a fixed seed)."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, label = truth(sample_page(rng))
        xs.append(page.features()), ys.append(label)
    x, y = np.concatenate(xs), np.concatenate(ys)
    return Boosted().fit(x, y, np.ones(len(y)))


def main_texts(sources: list[str], model: Boosted) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    logp = model.log_proba(np.concatenate([p.features() for p in pages]))
    ends = np.cumsum([len(p.tag) for p in pages])
    return [p.text(p.decode(logp[e - len(p.tag) : e])) for p, e in zip(pages, ends, strict=True)]


def extract_main_text(pages: DataFrame, *, model: Boosted | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of pages. Text is the main
    article's, references decoded, white space in a block as one space, blocks in
    page order joined by one space. A null or empty html, or one without main
    text, gives an empty text; a null id or url stays null; very long pages are
    read whole; an empty table gives an empty result. One pass without a shuffle;
    a row's result depends on its html alone, so repeated rows repeat; other
    columns are not read. Text of svg, math and noscript in the article counts,
    that of iframe and template does not."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = main_texts([s or "" for s in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
