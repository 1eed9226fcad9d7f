"""A small HTML tree for extraction: nodes in page order, texts with their owners, block breaks.

Tolerates unclosed and misnested tags, truncated pages and stray markup.  Raw
text elements (scripts, styles and the like) never give text; without an end tag
a script or a style goes on to the page's end, of any other only the tag goes.
Drawings, formulas and media are inline markup: what text they hold is judged
with the element around them.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TAGS = (
    "html body div section article main p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table tbody thead tfoot tr td th caption "
    "nav header footer aside form fieldset blockquote pre figure figcaption details summary address dialog menu hgroup center "
    "a button label select option span b i em strong small other"
).split()
TAG_ID = {t: i for i, t in enumerate(TAGS)}
BLOCK = set(TAGS[: TAGS.index("a")])
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe".split())
#: Inline markup that is no node of its own: its text is its parent's.
PLAIN = set("b i em strong small u s sub sup mark code kbd samp var cite q abbr time data font tt big del ins bdi bdo ruby rt rp dfn acronym svg g text tspan math mrow mi mn mo ms mtext mstyle msup msub msubsup mfrac msqrt mroot mover munder semantics object audio video canvas picture".split())
CLOSES_P = BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "li", "dt", "dd", "figcaption", "summary"} | {"hr"}
SCOPE = {"table", "td", "th", "button", "html", "body"}
#: A start tag ends an open element of these kinds, up to a list or table around it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Attribute tokens by what they say about an element.
TOKENS = {
    "content": "article content post entry main story body text prose copy page blog news",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toc pager pagination skip topnav sitemap",
    "header": "header masthead banner topbar top logo branding site contentinfo",
    "footer": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside widget rail complementary secondary column panel",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner dfp adsense commercial",
    "notice": "cookie cookies consent gdpr notice alert notification popup modal overlay warning toast message disclaimer",
    "comments": "comment comments commentlist disqus reply replies respond discussion discuss reader readers responses",
    "social": "share sharing social follow tweet facebook like likes",
    "related": "related recommended recommendations more popular trending teaser also next prev previous latest",
    "form": "form search login signin signup subscribe newsletter register input contact poll",
    "hidden": "hidden none invisible offscreen print sr",
}
GROUPS = list(TOKENS)
_GROUP_OF: dict[str, int] = {}
for _i, (_g, _words) in enumerate(TOKENS.items()):
    for _w in _words.split():
        _GROUP_OF[_w] = _GROUP_OF.get(_w, 0) | 1 << _i


@dataclass
class Page:
    """A parsed page; node 0 is the root, nodes are in page order, ``end[i]`` is past the last node under i."""

    tag: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)  # of own text
    linked: list[int] = field(default_factory=list)  # of own text inside links
    words: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)  # sentence marks and commas
    label: list[str] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)  # owner and decoded text; owner -1 is a break


_SEEN: dict[str, tuple[int, str]] = {}


def _attributes(raw: str) -> tuple[int, str]:
    """Groups of the attribute tokens, and the label that training pages carry."""
    if raw in _SEEN:
        return _SEEN[raw]
    groups, label = 0, ""
    for m in _ATTRIBUTE.finditer(raw):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for token in _TOKEN.findall(value):
                groups |= _GROUP_OF.get(token.lower(), 0)
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
            groups |= 1 << GROUPS.index("hidden")
        elif name == "data-label":
            label = value
    if len(_SEEN) > 50_000:
        _SEEN.clear()
    if len(raw) < 500:
        _SEEN[raw] = groups, label
    return groups, label


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = []  # open elements and their nodes; plain ones have their parent's
    links = 0

    def open_node(name: str, raw: str) -> None:
        node = len(page.tag)
        groups, label = _attributes(raw) if raw else (0, "")
        page.tag.append(TAG_ID.get(name, TAG_ID["other"]))
        page.parent.append(stack[-1][1] if stack else -1)
        page.depth.append(page.depth[stack[-1][1]] + 1 if stack else 0)
        page.end.append(node + 1)
        page.groups.append(groups)
        page.label.append(label)
        for counts in (page.chars, page.linked, page.words, page.stops):
            counts.append(0)
        stack.append((name, node))

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            name, node = stack.pop()
            if name == "a":
                links -= 1
            if name in BLOCK:
                page.texts.append((-1, ""))
            if not stack or stack[-1][1] != node:
                page.end[node] = len(page.tag)

    def close_kind(kinds: set[str], bounds: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in kinds:
                close(i)
                return
            if stack[i][0] in bounds:
                return

    def text(piece: str) -> None:
        if not piece or not stack:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        node = stack[-1][1]
        page.texts.append((node, piece))
        n = len(piece)
        page.chars[node] += n
        page.words[node] += piece.count(" ") + 1
        page.stops[node] += piece.count(".") + piece.count(",")
        if links > 0:
            page.linked[node] += n

    open_node("html", "")
    at, skip = 0, None
    for m in _MARKUP.finditer(source):
        begin = m.start()
        if begin < at:
            continue
        if begin > at:
            text(source[at:begin])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # an end tag
            if name == "br":
                page.texts.append((-1, ""))
            elif name not in ("html", "body"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if stack[i][0] in SCOPE and name in ("p", *PLAIN):
                        break
            continue
        raw = m[3] if m[2] else m[6]
        if name == "head":
            continue  # its elements count by themselves
        if name in RAW:
            if not (raw or "").rstrip().endswith("/"):
                skip = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I)
                found = skip.search(source, at)
                at = found.end() if found else len(source) if name in ("script", "style") else at
            continue
        if name in VOID:
            if name in ("br", "hr"):
                if name == "hr":
                    close_kind({"p"}, SCOPE)
                page.texts.append((-1, ""))
            continue
        if name in ("html", "body"):
            if raw and name == "body" and len(page.tag) == 1:
                open_node(name, raw)
            continue
        if name in CLOSES_P:
            close_kind({"p"}, SCOPE)
        if name in ENDS:
            close_kind(*ENDS[name])
        if name in BLOCK:
            page.texts.append((-1, ""))
        if name in PLAIN or name == "span" and not (raw or "").strip():
            stack.append((name, stack[-1][1]))
            continue
        if name == "a":
            links += 1
        open_node(name, raw or "")
    if at < len(source):
        text(source[at:])
    close(0)
    return page
