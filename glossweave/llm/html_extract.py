"""Main-text extraction from web pages by boosted trees over DOM nodes.

Each element gets features: its tag, depth, text and link densities of its
subtree, attribute tokens of its own and of its ancestors, and statistics of its
siblings.  Boosted trees give log probabilities of three states: *mixed* (holds
both article and other things), *article* and *other*.  Decoding finds the best
labelling of the whole tree in which other holds nothing but other, and article
only article and other; so no ancestor contradicts a descendant.  The text is
that of the article nodes, in page order.

The model is fitted on ``TRAINING_PAGES`` labelled pages that are generated here
from layouts with made-up words: the documented bound of its sample.  It is the
same for every run and some tens of kilobytes.

White space is turned into one space, blocks are joined by one space, character
references are decoded.  A null or empty page, or one without an article, gives
an empty text.  Repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gradient_trees import Trees, fit
from .html_tree import GROUPS, TAG_ID, TAGS, Page, parse

TRAINING_PAGES = 600
MIXED, ARTICLE, OTHER = range(3)
PAGES_AT_ONCE = 200
_KINDS = ["article main", "nav menu", "header", "footer", "aside", "form fieldset label select option button", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody thead tfoot tr td th caption", "blockquote pre figure figcaption", "div section center", "a", "body html", "span"]


def _kind_table() -> np.ndarray:
    out = np.zeros((len(TAGS), len(_KINDS)), np.float32)
    for k, names in enumerate(_KINDS):
        for n in names.split():
            out[TAG_ID[n], k] = 1
    return out


_KIND = _kind_table()


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all nodes; their parents (over all pages), depths, and the first node of each page."""
    sizes = np.array([len(p.tag) for p in pages])
    first = np.concatenate([[0], np.cumsum(sizes)])
    shift = np.repeat(first[:-1], sizes)
    column = lambda name: np.array([v for p in pages for v in getattr(p, name)], np.int64)
    tag, parent, end, depth, groups = column("tag"), column("parent"), column("end") + shift, column("depth"), column("groups")
    root = parent < 0
    parent = np.where(root, np.arange(len(tag)), parent + shift)
    own = {n: column(n).astype(np.float64) for n in ("chars", "linked", "words", "stops")}
    own["nodes"] = np.ones(len(tag))
    own["paragraphs"] = _KIND[tag, 6].astype(np.float64)
    own["anchors"] = _KIND[tag, 13].astype(np.float64)
    here = np.arange(len(tag))

    def under(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x)])
        return total[end] - total[here]

    sub = {n: under(x) for n, x in own.items()}
    page_chars = np.maximum(np.repeat(sub["chars"][first[:-1]], sizes), 1)
    before = np.concatenate([[0.0], np.cumsum(own["chars"])])[:-1]
    before -= np.repeat(before[first[:-1]], sizes)
    kind = _KIND[tag]
    bits = (groups[:, None] >> np.arange(len(GROUPS)) & 1).astype(np.float32)
    # of ancestors: top down, one depth after the other
    above_kind, above_bits = np.zeros_like(kind[:, :6]), np.zeros_like(bits)
    for i in by_depth(depth)[1:]:
        up = parent[i]
        above_kind[i] = np.maximum(above_kind[up], kind[up, :6])
        above_bits[i] = np.maximum(above_bits[up], bits[up])
    # of siblings: sums over the parent's children
    n_children = np.bincount(parent[~root], minlength=len(tag)).astype(np.float64)
    by_parent = lambda x: np.bincount(parent[~root], x[~root], len(tag))[parent]
    siblings = np.maximum(n_children[parent], 1)
    sibling_chars = by_parent(sub["chars"])
    same = parent * len(TAGS) + tag
    _, which, count = np.unique(same, return_inverse=True, return_counts=True)
    order = np.argsort(parent, kind="stable")
    place = np.empty(len(tag))
    place[order] = np.arange(len(tag)) - np.searchsorted(parent[order], parent[order])
    log = np.log1p
    numbers = np.stack(
        [
            depth, log(own["chars"]), log(sub["chars"]), log(sub["words"]), sub["linked"] / np.maximum(sub["chars"], 1), log(sub["anchors"]), log(sub["paragraphs"]),
            sub["chars"] / sub["nodes"], log(sub["nodes"]), sub["stops"] / np.maximum(sub["words"], 1), log(sub["stops"]), sub["chars"] / page_chars, before / page_chars,
            log(n_children), log(siblings), count[which] / siblings, place / siblings, sibling_chars / siblings, sub["chars"] / np.maximum(sibling_chars, 1),
            by_parent(sub["linked"]) / np.maximum(sibling_chars, 1), by_parent(sub["paragraphs"]) / siblings, own["chars"] / np.maximum(sub["chars"], 1),
        ],
        1,
    )
    # what the parent says about itself, for texts too short to speak
    from_parent = np.concatenate([kind[parent], bits[parent], numbers[parent][:, [2, 4, 6, 9, 11]]], 1)
    x = np.concatenate([kind, bits, above_kind, above_bits, numbers, from_parent], 1).astype(np.float32)
    return x, np.where(root, -1, parent), depth, first


def by_depth(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, from one sort, so that deep nesting costs its nodes alone."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))


def decode(score: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The states of the best labelling without a contradiction."""
    best = score.astype(np.float64).copy()
    levels = by_depth(depth)
    for nodes in reversed(levels[1:]):
        b = best[nodes]
        from_article = np.maximum(b[:, ARTICLE], b[:, OTHER])
        gain = np.stack([np.maximum(b[:, MIXED], from_article), from_article, b[:, OTHER]], 1)
        np.add.at(best, parent[nodes], gain)
    state = np.empty(len(score), np.int64)
    for d, nodes in enumerate(levels):
        b = best[nodes].copy()
        if d:
            up = state[parent[nodes]]
            b[up != MIXED, MIXED] = -np.inf
            b[up == OTHER, ARTICLE] = -np.inf
        state[nodes] = b.argmax(1)
    return state


def main_texts(sources: list[str | None], model: Trees) -> list[str]:
    pages = [parse(s or "") for s in sources]
    x, parent, depth, first = features(pages)
    state = decode(model.log_probabilities(x), parent, depth)
    out = []
    for page, lo in zip(pages, first[:-1].tolist()):
        keep = (state[lo : lo + len(page.tag)] == ARTICLE).tolist()
        out.append(" ".join("".join(" " if owner < 0 else piece for owner, piece in page.texts if owner < 0 or keep[owner]).split()))
    return out


class _Layout:
    """Made-up labelled pages: ``data-label`` says what an element is, ``m``, ``a`` or ``o``."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = self.r.random()  # how telling attributes are on this page
        self.semantic = self.r.random() < 0.7

    def word(self) -> str:
        return "".join(self.r.choice(("ka", "lo", "mi", "ten", "ru", "sal", "o", "bri", "dun", "é", "ü", "the", "ing")) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() + self.r.choice(("", "", "", "", ",", "", "", ".", "!!", "&amp;", "***")) * (self.r.random() < 0.5) for _ in range(self.r.randint(lo, hi)))

    def prose(self, lo: int = 4, hi: int = 60) -> str:
        return self.words(lo, hi).capitalize() + self.r.choice((".", ".", ".", "", "%"))

    def element(self, tag: str, label: str, inner: str, tokens: str = "", closed: bool = True) -> str:
        attribute = ""
        if tokens and self.r.random() < 0.35 + 0.65 * self.style:
            name = self.r.choice(("class", "class", "id"))
            chosen = self.r.choice(tokens.split())
            attribute = f' {name}="{self.r.choice(("", "", "x-", "site-", "js "))}{chosen}{self.r.choice(("", "", "-box", "__inner", "1", " wide"))}"'
        elif self.r.random() < 0.15:
            attribute = f' class="{self.r.choice("row col wrap c12 inner grid u-mt container".split())}"'
        return f'<{tag}{attribute} data-label="{label}">{inner}' + f"</{tag}>" * closed

    def link(self, label: str, lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/{self.word()}" data-label="{label}">{self.words(lo, hi)}</a>'

    def links(self, label: str = "o", n: tuple[int, int] = (2, 10), tokens: str = "") -> str:
        k = self.r.randint(*n)
        if self.r.random() < 0.7:
            return self.element(self.r.choice(("ul", "ul", "ol")), label, "".join(f'<li data-label="{label}">{self.link(label)}</li>' for _ in range(k)), tokens)
        return self.element("div", label, self.r.choice((" ", " | ", "")).join(self.link(label) for _ in range(k)), tokens)

    def inline(self, text: str) -> str:
        if self.r.random() < 0.25:
            w = text.split(" ")
            i = self.r.randrange(len(w))
            kind = self.r.choice(("b", "i", "em", "strong", "a", "span", "code"))
            w[i] = self.link("a", 1, 4) if kind == "a" else f"<{kind}>{w[i]}</{kind}>"
            text = " ".join(w)
        return text

    def paragraph(self, label: str = "a", hi: int = 90) -> str:
        text = self.inline(self.prose(1, hi)) if label == "a" else self.prose(1, hi)
        if self.r.random() < 0.12:
            return f'<p data-label="{label}"><b>{text}<br>'  # left open, as pages do
        return f'<p data-label="{label}">{text}' + "</p>" * (self.r.random() < 0.93)

    def boilerplate(self) -> str:
        """A block that isn't the article."""
        r, e = self.r, self.element
        kind = r.randrange(12)
        if kind == 0:
            return e(r.choice(("nav", "nav", "div")) if self.semantic else "div", "o", self.links(tokens="menu tabs"), "nav menu navbar breadcrumb")
        if kind <= 2:
            return e(r.choice(("div", "div", "aside", "section", "p")), "o", self.prose(1, 40) + (self.link("o") if r.random() < 0.4 else ""), "ad ads advert sponsor promo banner")
        if kind == 3:
            return e(r.choice(("aside", "div")) if self.semantic else "div", "o", "".join(r.choice((self.links, lambda: self.paragraph("o", 30), lambda: f'<h3 data-label="o">{self.words(1, 4)}</h3>'))() for _ in range(r.randint(1, 4))), "sidebar aside widget")
        if kind == 4:
            return e("div", "o", self.paragraph("o", 30) + '<button data-label="o">OK</button>' * (r.random() < 0.6), "cookie notice consent alert")
        if kind == 5:
            return e("form", "o", f'<label data-label="o">{self.words(1, 4)}</label><input name="q"><button data-label="o">{self.words(1, 2)}</button>' + self.paragraph("o", 20) * (r.random() < 0.3), "search subscribe newsletter login form")
        if kind <= 7:
            def comment() -> str:
                return e(r.choice(("div", "li", "article")) if self.semantic else "div", "o", f'<span class="author" data-label="o">{self.words(1, 2)}</span>' * (r.random() < 0.5) + "".join(self.paragraph("o", 40) for _ in range(r.randint(1, 2))), "comment reply")
            return e(r.choice(("section", "div", "ol", "ul")), "o", f'<h3 data-label="o">{self.words(1, 3)}</h3>' * (r.random() < 0.6) + "".join(comment() for _ in range(r.randint(1, 6))), "comments commentlist discussion responses") if self.style > 0.1 else self.links()
        if kind == 8:
            return e("div", "o", self.links(n=(2, 5)), "share social follow")
        if kind == 9:
            return e(r.choice(("div", "section", "aside")), "o", f'<h4 data-label="o">{self.words(1, 4)}</h4>' + self.links(n=(2, 6)), "related recommended popular trending")
        if kind == 10:
            return f'<script>var t="</p><p>{self.words(3, 9)}";</script><style>p{{margin:0}}</style><!-- {self.words(1, 5)} -->'
        return e("div", "o", self.link("o") + " &raquo; " + self.link("o"), "breadcrumb pagination")

    def head(self) -> str:
        inner = f'<div data-label="o">{self.link("o")}</div>' * (self.r.random() < 0.5) + f'<p data-label="o">{self.words(2, 9)}</p>' * (self.r.random() < 0.4) + f'<h1 data-label="o">{self.words(1, 3)}</h1>' * (self.r.random() < 0.25) + self.links() * (self.r.random() < 0.5)
        return self.element("header" if self.semantic else "div", "o", inner, "header masthead banner topbar logo") if inner else ""

    def foot(self) -> str:
        inner = self.r.choice(("&copy; ", "", "© ")) + self.words(1, 3) + " &middot; " * (self.r.random() < 0.5) + self.prose(2, 25)
        if self.r.random() < 0.4:
            inner = f'<p data-label="o">{inner}</p>' + self.links() * (self.r.random() < 0.5)
        return self.element("footer" if self.semantic or self.r.random() < 0.3 else "div", "o", inner, "footer bottom copyright")

    def article(self) -> str:
        r, e = self.r, self.element
        blocks = [f'<h1 data-label="a">{self.words(1, 12)}</h1>'] if r.random() < 0.75 else []
        tiny = r.random() < 0.2
        if tiny:
            blocks.append(self.paragraph(hi=5))
        for _ in range(0 if tiny else r.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.75:
                blocks.append(self.paragraph())
            elif kind < 0.82:
                blocks.append(f'<{(t := r.choice(("h2", "h3")))} data-label="a">{self.words(1, 7)}</{t}>')
            elif kind < 0.88:
                blocks.append(f'<{(t := r.choice(("ul", "ol")))} data-label="a">' + "".join(f'<li data-label="a">{self.inline(self.prose(1, 25))}' + "</li>" * (r.random() < 0.9) for _ in range(r.randint(1, 6))) + f"</{t}>")
            elif kind < 0.92:
                blocks.append(f'<blockquote data-label="a">{self.paragraph()}</blockquote>')
            elif kind < 0.95:
                blocks.append('<table data-label="a">' + "".join('<tr data-label="a">' + "".join(f'<td data-label="a">{self.words(1, 5)}</td>' for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.97:
                blocks.append(f'<figure data-label="a"><img src="x"><figcaption data-label="a">{self.prose(2, 15)}</figcaption></figure>')
            else:
                blocks.append(f'<div data-label="a">{self.paragraph()}{self.paragraph()}</div>')
        for _ in range(r.choice((0, 0, 0, 1, 2))):  # things that stand in the article and aren't of it
            blocks.insert(r.randint(0, len(blocks)), self.boilerplate())
        inner = "".join(blocks)
        if r.random() < 0.25:
            inner = e("div", "a", inner, "content body entry text")
        tag = r.choice(("article", "article", "main", "section", "div")) if self.semantic else "div"
        return e(tag, "a", inner, "article content post entry main story")

    def page(self) -> str:
        r = self.r
        upper = [self.head()] * (r.random() < 0.5) + [self.boilerplate() for _ in range(r.randint(0, 4))]
        lower = [self.boilerplate() for _ in range(r.randint(0, 4))] + [self.foot()] * (r.random() < 0.75)
        core = self.article() if r.random() < 0.97 else ""
        if r.random() < 0.35:
            around = [self.boilerplate() for _ in range(r.randint(0, 2))]
            core = self.element(r.choice(("div", "main", "section")), "m" if around else "a", (around[0] if around else "") + core + "".join(around[1:]), "wrapper container main content")
        body = "".join(upper) + core + "".join(lower)
        if r.random() < 0.2:
            body = self.element("div", "m", body, "page wrap")
        out = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{self.words(1, 9)}</title></head><body>{body}</body></html>"
        return out[: r.randint(len(out) // 2, len(out))] if r.random() < 0.1 else out


def labelled(n: int = TRAINING_PAGES, seed: int = 1) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Feature rows and states of generated pages, and the pages."""
    sources = [_Layout(seed * 1_000_003 + i).page() for i in range(n)]
    pages = [parse(s) for s in sources]
    x, _, _, _ = features(pages)
    y = []
    for p in pages:
        for i, label in enumerate(p.label):
            y.append({"m": MIXED, "a": ARTICLE, "o": OTHER}.get(label, y[-(i - p.parent[i])] if p.parent[i] >= 0 else MIXED))
    return x, np.array(y), sources


@cache
def trained(n: int = TRAINING_PAGES) -> Trees:
    """The fitted model; the same for every run."""
    x, y, _ = labelled(n)
    return fit(x, y, 3, trees=60, depth=5)


def extract(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """(page_id, url, text) of every page."""
    held = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(lo, PAGES_AT_ONCE)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(main_texts(part.column("html").to_pylist(), held.value), pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string")
