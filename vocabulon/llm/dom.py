"""A forgiving HTML reader: block elements and runs of text, in page order, with features of each.

Only what features need is kept.  Inline elements belong to the run they stand in; scripts, styles,
form controls and other elements without readable text vanish with their content, up to their own end
or their parent's, or alone where neither comes; missing end tags are implied as browsers imply them.
Reading takes time in proportion to the page, however deep its elements are nested.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import numpy as np

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(id|class|role|itemprop|aria-label|data-role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SILENT = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg canvas audio video select datalist button applet annotation annotation-xml".split())
#: What stands in these isn't markup; without an end tag they reach to the page's end, as in browsers.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_BLOCKS = frozenset(
    "html body div p section article main header footer nav aside form fieldset details summary dialog h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address center hgroup menu search".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = _BLOCKS - frozenset("html body".split())
#: A start tag ends the open elements named first, as far up as the ones named second.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}

TAGS = ("run", "p", "h1", "heading", "div", "list", "li", "table", "cell", "nav", "header", "footer", "aside", "form", "article", "main", "section", "quote", "figure", "page", "other")
_KIND = {
    "p": "p", "h1": "h1", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "hgroup": "heading", "div": "div", "center": "div",
    "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "li": "li", "dt": "li", "dd": "li", "table": "table", "thead": "table", "tbody": "table", "tfoot": "table",
    "tr": "table", "td": "cell", "th": "cell", "caption": "cell", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form",
    "search": "form", "article": "article", "main": "main", "section": "section", "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure",
    "html": "page", "body": "page", "": "page",
}
_KIND = {k: TAGS.index(v) for k, v in _KIND.items()}
_OTHER = TAGS.index("other")
# Words of ids and classes, by what they tell about an element.
FAMILIES = {
    "nav": "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager tabs toc sitemap skip",
    "header": "header head masthead banner topbar top logo branding brand tagline",
    "footer": "footer foot bottom copyright colophon legal imprint contentinfo",
    "side": "sidebar side aside widget widgets related recommended recommendations rail popular trending latest similar complementary teaser teasers",
    "ad": "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion dfp outbrain taboola",
    "notice": "cookie cookies consent notice notices alert gdpr newsletter subscribe subscription popup modal overlay paywall warning toast disclaimer message announcement",
    "comment": "comment comments commentlist reply replies discussion disqus respond feedback thread review reviews reader responses",
    "share": "share sharing social follow like likes twitter facebook bookmark tools",
    "form": "form search login signin signup register contact input field",
    "main": "article content main post entry story body text prose blog page hentry maincontent articlebody copy",
    "meta": "author byline date meta tags tag category categories time posted info",
}
_FAMILY = {w: 1 << i for i, (_, ws) in enumerate(FAMILIES.items()) for w in ws.split()}
N_FAMILIES = len(FAMILIES)
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Page:
    """Nodes of a page in order: parents come before children.  text is that of runs, None for elements."""

    __slots__ = ("parent", "kind", "family", "depth", "links", "text", "controls", "label")

    def __init__(self):
        self.parent, self.kind, self.family, self.depth, self.links, self.text, self.controls = [-1], [_KIND[""]], [0], [0], [0], [None], [0]

    def add(self, parent: int, kind: int, family: int, text: str | None, links: int) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.family.append(family)
        self.depth.append(self.depth[parent] + 1)
        self.links.append(links)
        self.text.append(text)
        self.controls.append(0)
        return len(self.parent) - 1

    def cut(self, to: int) -> None:
        """Forgets the nodes from ``to`` on."""
        for a in (self.parent, self.kind, self.family, self.depth, self.links, self.text, self.controls):
            del a[to:]


def _family(attributes: str) -> int:
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        for w in _WORDS.findall(m[2] or m[3] or m[4] or ""):
            found |= _FAMILY.get(w.lower(), 0)
    return found


class _Open:
    """The open elements, with the places of each name, so no tag walks the whole stack."""

    def __init__(self):
        self.names, self.nodes, self.silent, self.places = [""], [0], [], {}

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def cut(self, to: int) -> None:
        for name in self.names[to:]:
            self.places[name].pop()
        del self.names[to:], self.nodes[to:]

    def last(self, *names: str) -> int:
        """The place of the innermost of ``names``; 0 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def first_after(self, place: int, *names: str) -> int:
        """The place of the outermost of ``names`` inside ``place``; 0 if none is."""
        found = [p[at] for n in names if (p := self.places.get(n)) and (at := bisect_right(p, place)) < len(p)]
        return min(found, default=0)


def parse(source: str) -> Page:
    """The nodes of a page.  A silent element ends with its end tag or its parent; one that never does hides nothing."""
    ignored: set[int] = set()
    while True:
        page, endless = _parse(source, ignored)
        if not endless:
            return page
        ignored |= endless


def _parse(source: str, ignored: set[int]) -> tuple[Page, set[int]]:
    """Reads a page without the silent start tags at ``ignored``; the places of those that are open at its end come with it."""
    page, stack = Page(), _Open()
    pieces: list[str] = []
    linked = [0, 0]  # open links, characters in them
    def flush() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.add(stack.nodes[-1], 0, 0, text, min(linked[1], len(text)))
            pieces = []
        linked[1] = 0

    def data(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if linked[0]:
            linked[1] += len(text.strip())

    def close(to: int) -> None:
        """Ends the elements from place ``to`` on; what stands in silent ones among them was never there."""
        nonlocal pieces
        while stack.silent and stack.silent[-1][0] >= to:
            place, mark, pieces, linked[:], _ = stack.silent.pop()
            page.cut(mark)
            stack.cut(place)
        if len(stack.names) > to:
            flush()
            stack.cut(to)

    at, n, in_head = 0, len(source), False
    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            if not in_head:
                data(source[at:])
            break
        if m.start() > at and not in_head:
            data(source[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "head":
                in_head = False
            elif name == "a":
                linked[0] = max(0, linked[0] - 1)
            elif name in _SILENT:
                place = stack.last(name)
                if place:
                    close(place)
            elif name in _BLOCKS:
                place = stack.last(name)
                if place:
                    close(place)
                else:
                    flush()
            continue
        name = (m[2] or m[4] or "").lower()
        if not name:
            continue
        attributes = m[3] if m[2] else m[5]
        if name == "head":
            in_head = True
            continue
        if name in _RAW:
            if not attributes.endswith("/") or name in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
            if name == "textarea" and not stack.silent:
                page.controls[stack.nodes[-1]] += 1
            continue
        if name in _SILENT:
            if name == "button" and (place := stack.last(name)):
                close(place)  # a button can't hold a button
            if not stack.silent and name in ("select", "button"):
                page.controls[stack.nodes[-1]] += 1
            if not attributes.endswith("/") and not in_head and m.start() not in ignored:
                stack.silent.append((len(stack.names), len(page.parent), pieces, linked[:], m.start()))
                stack.push(name, stack.nodes[-1])
                pieces, linked[:] = [], (0, 0)
            continue
        if name == "body":
            in_head = False
        if in_head:
            if name not in _BLOCKS:
                continue
            in_head = False  # content begins without the head's end
        if name == "a":
            linked[0] = 1
        elif name in ("br", "hr", "img"):
            pieces.append(" ")
            if name == "hr":
                flush()
        elif name == "input":
            if not stack.silent:
                page.controls[stack.nodes[-1]] += 1
        elif name in _BLOCKS:
            flush()
            if name in ("html", "body"):
                if stack.last(name):
                    continue
            elif name in _ENDS_P:
                place = stack.last("p")
                if place > stack.last("table", "td", "th", "caption", *_SILENT):
                    close(place)
            if name in _IMPLIED:
                ends, up_to = _IMPLIED[name]
                bound = stack.last(*up_to, *_SILENT)
                cut = stack.last(*ends) if name in ("li", "dt", "dd", "td", "th") else stack.first_after(bound, *ends)
                if cut > bound:
                    close(cut)
            node = page.add(stack.nodes[-1], _KIND.get(name, _OTHER), _family(attributes) if attributes else 0, None, 0)
            linked[0] = 0
            stack.push(name, node)
    flush()
    return page, {s[-1] for s in stack.silent}


def features(page: Page) -> np.ndarray:
    """One row per node: subtree density, attribute tokens, depth and sibling statistics."""
    n = len(page.parent)
    parent = page.parent
    chars = [len(t) if t else 0 for t in page.text]
    words = [t.count(" ") + 1 if t else 0 for t in page.text]
    marks = [len(_PUNCTUATION.findall(t)) if t else 0 for t in page.text]
    links, controls = list(page.links), list(page.controls)
    runs, kids, paragraphs, nodes = [int(t is not None) for t in page.text], [0] * n, [int(k == 1) for k in page.kind], [1] * n
    before, total = [0] * n, 0
    for i in range(n):
        before[i] = total
        total += chars[i]
    inner = [1 << k for k in page.kind]  # kinds in the subtree
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (chars, words, marks, links, controls, runs, paragraphs, nodes):
            a[p] += a[i]
        kids[p] += 1
        inner[p] |= inner[i]
    above_family, above_kind, index, same = [0] * n, [0] * n, [0] * n, [0] * n
    last, next_chars, before_chars = [-1] * n, [0] * n, [0] * n
    kinds_of: list[dict[int, int] | None] = [None] * n
    for i in range(1, n):
        p = parent[i]
        above_family[i] = above_family[p] | page.family[p]
        above_kind[i] = above_kind[p] | (1 << page.kind[p])
        if kinds_of[p] is None:
            kinds_of[p] = {}
        c = kinds_of[p]
        c[page.kind[i]] = c.get(page.kind[i], 0) + 1
        if last[p] >= 0:
            index[i] = index[last[p]] + 1
            before_chars[i] = chars[last[p]]
            next_chars[last[p]] = chars[i]
        last[p] = i
    for i in range(1, n):
        same[i] = kinds_of[parent[i]][page.kind[i]]
    ar = lambda a: np.array(a, np.float64)
    up = np.array([0, *parent[1:]])
    chars, words, nodes = ar(chars), ar(words), ar(nodes)
    bits = lambda a, k: (np.array(a, np.int64)[:, None] >> np.arange(k)) & 1
    columns = [
        ar(page.depth), ar(kids), ar(index), ar(index) / np.maximum(1, ar(kids)[up]), ar(kids)[up], ar(same), ar(same) / np.maximum(1, ar(kids)[up]),
        np.log1p(chars), chars / max(1, total), chars / np.maximum(1, chars[up]), ar(links) / np.maximum(1, chars), chars / nodes, np.log1p(words),
        ar(marks) / np.maximum(1, words), words / np.maximum(1, ar(runs)), ar(before) / max(1, total), (ar(before) + chars) / max(1, total),
        np.log1p(ar(before_chars)), np.log1p(ar(next_chars)), ar(controls), ar(paragraphs), ar(runs), np.log1p(nodes), np.log1p(np.full(n, float(total))),
    ]
    parent_kind = np.eye(len(TAGS))[np.array(page.kind)[up]]
    return np.concatenate(
        [np.stack(columns, axis=1), np.eye(len(TAGS))[page.kind], parent_kind, bits(page.family, N_FAMILIES), bits(above_family, N_FAMILIES), bits(above_kind, len(TAGS)), bits(inner, len(TAGS))],
        axis=1,
    )
