"""Main text of HTML pages by boosted trees over DOM nodes and hierarchical decoding.

Every block element and every run of text of a page is a node with features of its subtree's
density, its attribute tokens, its depth and its siblings.  Boosted trees give each node the
log-odds of holding main text.  Decoding picks the labelling of the whole tree with the largest sum
of log-odds in which nothing is kept below a dropped element: a subtree's best sum is its own plus
those of its children that are worth keeping.

The trees are fitted on ``PAGES`` pages from a generator that composes known parts (article,
menus, headers, sidebars, notices, adverts, forms, comments, footers) in many layouts, markups and
name styles, so each run's label is known; held-out pages test it.

Defined cases: null or empty html and pages without main text give an empty text; truncated tags,
comments and scripts end with the page; repeated rows each get a row; pages of any length are read
whole; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting, dom

PAGES, SEED = 800, 7
#: Marks main text in generated pages; removed before features are taken.
MARK = ""


@cache
def _vocabulary(n: int = 2000) -> list[str]:
    rng = np.random.default_rng(SEED)
    return ["".join(rng.choice(list("aeioubcdlmnprst"), int(rng.integers(1, 10)))) for _ in range(n)]


class _Writer:
    """Writes one random page."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.out = rng, []
        self.tidy = rng.random() < 0.6  # end tags of p and li are there
        self.semantic = rng.random()
        self.named = rng.random() < 0.85

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, lo: int, hi: int) -> str:
        known = _vocabulary()
        out = [known[i] for i in self.rng.integers(len(known), size=int(self.rng.integers(lo, hi + 1))).tolist()]
        if self.chance(0.02):
            out = [w + self.pick("***", "%%%", "&amp;&amp;", "!!") for w in out]
        return " ".join(out)

    def prose(self, lo: int, hi: int) -> str:
        """Sentences of lo..hi words in all."""
        left, out = int(self.rng.integers(lo, hi + 1)), []
        while left > 0:
            n = min(left, int(self.rng.integers(1, 22)))
            s = self.words(n, n).capitalize()
            if n > 6 and self.chance(0.5):
                s = s.replace(" ", ", ", 1)
            if self.chance(0.05):
                s = s.replace(" ", self.pick(" &amp; ", " &quot;", " <em>x</em> ", " <a href='/x'>link</a> ", "<br>"), 1)
            out.append(s + self.pick(".", ".", ".", "?", "!"))
            left -= n
        return " ".join(out)

    def attributes(self, *names: str) -> str:
        if not self.named:
            return ""
        name = self.pick(*names)
        extra = self.pick("", "", "", " row", " col-8", "-wrap", "-inner", "__block", " clearfix")
        return f' {self.pick("class", "class", "id")}="{name}{extra}"'

    def el(self, tag: str, content: str, attributes: str = "", close: bool = True) -> str:
        return f"<{tag}{attributes}>{content}" + (f"</{tag}>" if close else "")

    def p(self, text: str, attributes: str = "") -> str:
        return self.el("p", text, attributes, self.tidy or self.chance(0.7))

    def links(self, lo: int, hi: int) -> str:
        items = [self.el("a", self.words(1, 3), f' href="/{self.words(1, 1)}"') for _ in range(int(self.rng.integers(lo, hi)))]
        if self.chance(0.75):
            return self.el(self.pick("ul", "ul", "ol"), "".join(self.el("li", x, "", self.tidy) for x in items), self.attributes("menu", "list", "links") if self.chance(0.3) else "")
        return self.pick(" | ", " ", " &middot; ", "<br>").join(items)

    def menu(self) -> str:
        tag = "nav" if self.chance(0.6) else "div"
        return self.el(tag, self.links(2, 10), "" if tag == "nav" and self.chance(0.5) else self.attributes("menu", "nav", "navbar", "navigation", "breadcrumbs", "main-menu", "topMenu", "pagination"))

    def header(self) -> str:
        inner = self.pick(self.el("a", self.words(1, 3), ' href="/"'), self.el("h1", self.words(1, 4)), self.el("div", self.words(1, 4), self.attributes("logo", "branding", "site-title")))
        inner += self.p(self.words(2, 9), self.attributes("tagline", "subtitle")) if self.chance(0.5) else ""
        inner += self.menu() if self.chance(0.4) else ""
        inner += self.form() if self.chance(0.15) else ""
        tag = "header" if self.chance(0.6) else "div"
        return self.el(tag, inner, "" if tag == "header" and self.chance(0.5) else self.attributes("header", "masthead", "site-header", "topbar", "banner", "pageHeader"))

    def footer(self) -> str:
        inner = self.pick("&copy; ", "Copyright ", "&copy; 2020 ") + self.words(1, 4) + self.pick(" &middot; ", ". ", " ") + (self.prose(3, 25) if self.chance(0.6) else "")
        inner = self.p(inner) if self.chance(0.5) else inner
        inner += self.links(1, 8) if self.chance(0.5) else ""
        tag = "footer" if self.chance(0.65) else "div"
        return self.el(tag, inner, "" if tag == "footer" and self.chance(0.5) else self.attributes("footer", "site-footer", "copyright", "pageFooter", "legal"))

    def ad(self) -> str:
        inner = self.pick(self.prose(3, 20), self.p(self.prose(3, 25)), self.el("a", self.words(2, 8), ' href="/buy"'), self.el("span", "Advertisement") + self.prose(3, 20))
        return self.el(self.pick("div", "div", "aside", "section"), inner, f' {self.pick("class", "class", "id")}="{self.pick("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "adBox", "ad-banner", "sponsor")}"')

    def notice(self) -> str:
        inner = self.p(self.prose(5, 45)) if self.chance(0.7) else self.prose(5, 35)
        inner += self.el("button", self.words(1, 2)) if self.chance(0.6) else ""
        return self.el(self.pick("div", "div", "section", "aside", "p"), inner, f' {self.pick("class", "class", "id", "role")}="{self.pick("cookie", "cookie-notice", "notice", "alert", "consent", "newsletter", "gdpr-banner", "site-notice", "cookieConsent", "subscribe-box", "disclaimer")}"')

    def form(self) -> str:
        inner = self.el("label", self.words(1, 3)) + '<input type="text" name="q">' + (self.p(self.prose(3, 20)) if self.chance(0.4) else "") + self.pick('<input type="submit" value="Go">', self.el("button", "Go"), "<select><option>a<option>b</select>")
        form = self.el("form", inner, self.pick("", self.attributes("search", "signup", "login", "contact-form", "subscribe")))
        return self.el("div", (self.el("h3", self.words(1, 4)) if self.chance(0.5) else "") + form, self.attributes("search", "signup", "widget", "box")) if self.chance(0.4) else form

    def widget(self) -> str:
        inner = self.el(self.pick("h2", "h3", "h4"), self.words(1, 4))
        inner += self.pick(self.links(2, 9), self.p(self.prose(5, 45)), self.prose(3, 25), "".join(self.p(self.el("a", self.words(3, 10), ' href="/r"')) for _ in range(int(self.rng.integers(1, 5)))))
        return self.el(self.pick("div", "section", "div"), inner, self.attributes("widget", "related", "popular", "box", "module")) if self.chance(0.6) else inner

    def sidebar(self) -> str:
        inner = "".join(self.pick(self.widget, self.widget, self.ad, self.form)() for _ in range(int(self.rng.integers(1, 4))))
        inner = self.pick(inner, inner, self.p(self.prose(5, 40)), self.prose(3, 30))
        tag = "aside" if self.chance(0.6) else "div"
        return self.el(tag, inner, "" if tag == "aside" and self.chance(0.5) else self.attributes("sidebar", "side", "right-sidebar", "secondary", "rail", "related"))

    def comments(self) -> str:
        items = []
        for _ in range(int(self.rng.integers(1, 6))):
            who = self.pick("", self.el("b", self.words(1, 2)), self.el("h4", self.words(1, 2)), self.el("span", self.words(1, 2), self.attributes("author", "user")), self.p(self.words(1, 2), self.attributes("author", "meta")))
            body = self.pick(self.p(self.prose(2, 60)), self.prose(2, 40), self.p(self.prose(5, 40)) + self.p(self.prose(5, 40)))
            items.append(self.el(self.pick("div", "article", "li", "section", "p"), who + body + (self.el("a", "Reply", ' href="#r"') if self.chance(0.3) else ""), f' class="{self.pick("comment", "reply", "comment-body", "commentItem")}"' if self.chance(0.8) else ""))
        inner = (self.el(self.pick("h2", "h3"), self.words(1, 3)) if self.chance(0.6) else "") + "".join(items) + (self.form() if self.chance(0.3) else "")
        return self.el(self.pick("section", "div", "div", "ol", "ul", "aside"), inner, f' {self.pick("class", "id")}="{self.pick("comments", "comment-list", "discussion", "replies", "disqus_thread", "respond", "reader-comments", "commentSection")}"')

    def share(self) -> str:
        return self.el("div", self.links(2, 5), f' class="{self.pick("share", "social", "share-buttons", "social-links")}"')

    def main(self) -> str:
        """The article: every run of it carries the mark."""
        m = MARK
        parts = []
        if self.chance(0.85):
            title = self.el(self.pick("h1", "h1", "h2"), m + self.words(1, 12))
            parts.append(self.el("header", title) if self.chance(0.15) else title)
        for _ in range(int(min(40, 1 + self.rng.geometric(0.15)))):
            kind = self.rng.random()
            if kind < 0.75:
                text = m + self.prose(*self.pick((1, 4), (5, 30), (20, 120), (60, 200)))
                text = "<b>" + text + "<br>" if self.chance(0.06) else text
                parts.append(self.p(text) if self.chance(0.93) else self.el("div", text))
            elif kind < 0.83:
                parts.append(self.el(self.pick("h2", "h3", "h4"), m + self.words(1, 8)))
            elif kind < 0.88:
                parts.append(self.el(self.pick("ul", "ol"), "".join(self.el("li", m + self.prose(1, 25), "", self.tidy) for _ in range(int(self.rng.integers(1, 7))))))
            elif kind < 0.91:
                parts.append(self.el("blockquote", self.p(m + self.prose(5, 50)) if self.chance(0.5) else m + self.prose(5, 50)))
            elif kind < 0.92:
                parts.append(self.el("pre", m + self.words(3, 40)))
            elif kind < 0.94:
                parts.append(self.el("figure", '<img src="x.png">' + self.el("figcaption", m + self.words(3, 15))))
            elif kind < 0.95:
                parts.append(self.el("table", "".join(self.el("tr", "".join(self.el("td", m + self.words(1, 3)) for _ in range(3))) for _ in range(int(self.rng.integers(1, 5))))))
            elif kind < 0.97:
                parts.append(self.pick(self.ad, self.notice, self.share, self.sidebar, self.form)())
            else:
                parts.append("<script>var a = '<p>';</script>")
        body = "".join(parts)
        box = self.rng.random()
        if box < 0.4:
            body = self.el("article", body, self.attributes("post", "article", "entry", "story") if self.chance(0.4) else "")
        elif box < 0.55:
            body = self.el("section" if self.chance(0.3) else "div", body, self.attributes("content", "post", "entry-content", "article-body", "story", "articleBody", "post-content", "text", "prose"))
        elif box < 0.65:
            body = self.el("div", body)
        if self.chance(0.4):
            body = self.el("main", body) if self.chance(0.6) else self.el("div", body, self.attributes("main", "content", "main-content", "primary"))
        return body

    def page(self) -> str:
        top = [f() for f, p in ((self.notice, 0.2), (self.header, 0.5), (self.menu, 0.6), (self.ad, 0.3), (self.form, 0.1)) if self.chance(p)]
        if self.chance(0.3):
            self.rng.shuffle(top)
        middle = self.main() if self.chance(0.97) else ""
        if self.chance(0.45):
            middle = self.sidebar() + middle if self.chance(0.4) else middle + self.sidebar()
        if self.chance(0.15):
            middle = self.pick(self.menu, self.ad, self.notice)() + middle
        after = [f() for f, p in ((self.share, 0.1), (self.widget, 0.1), (self.comments, 0.4), (self.ad, 0.15), (self.notice, 0.15), (self.form, 0.1), (self.footer, 0.8)) if self.chance(p)]
        if self.chance(0.4):
            middle = self.el("div", middle + (after.pop(0) if after and self.chance(0.3) else ""), self.attributes("wrapper", "container", "page", "layout", "site"))
        body = "".join(top) + middle + "".join(after)
        if self.chance(0.25):
            body = self.el("div", body, self.attributes("wrapper", "container", "page", "site", "app"))
        head = f'<head><meta charset="utf-8"><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style></head>' if self.chance(0.9) else ""
        return f"<!DOCTYPE html><html{self.pick('', ' lang=en')}>{head}<body>{body}" + self.pick("</body></html>", "</body></html>", "")


def generated(n: int, seed: int) -> list[str]:
    """``n`` random pages in which the mark precedes every run of main text."""
    rng = np.random.default_rng(seed)
    return [_Writer(rng).page() for _ in range(n)]


def labelled(source: str) -> tuple[dom.Page, np.ndarray]:
    """A generated page without its marks, and each node's label: whether it holds main text."""
    page = dom.parse(source)
    label = np.array([t is not None and MARK in t for t in page.text])
    for i in range(len(label) - 1, 0, -1):
        if label[i]:
            label[page.parent[i]] = True
    page.text = [t.replace(MARK, "") if t else t for t in page.text]
    return page, label


@cache
def model(pages: int = PAGES, seed: int = SEED) -> boosting.Boosted:
    rows, labels = [], []
    for source in generated(pages, seed):
        page, label = labelled(source)
        rows.append(dom.features(page)[1:])
        labels.append(label[1:])
    return boosting.fit(np.concatenate(rows), np.concatenate(labels).astype(float))


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The best labelling in which no node is kept below a dropped one; the root is always kept."""
    gain = odds.tolist()
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    kept = [True] * len(gain)
    for i in range(1, len(gain)):
        kept[i] = gain[i] > 0 and kept[parent[i]]
    return np.array(kept)


def main_texts(sources: list[str | None], trees: boosting.Boosted) -> list[str]:
    pages = [dom.parse(s or "") for s in sources]
    rows = [dom.features(p) for p in pages]
    odds = trees.score(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p in pages:
        n = len(p.parent)
        kept = decode(p.parent, odds[at : at + n])
        at += n
        out.append(" ".join(t for t, k in zip(p.text, kept, strict=True) if k and t))
    return out


def extracted(pages: DataFrame, trees: boosting.Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars of ``pages`` (page_id, url, html)."""
    trees = trees or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 100):
                b = big.slice(lo, 100)
                texts = main_texts(b.column("html").to_pylist(), trees)
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    picked = pages.select("page_id", "url", "html")
    return picked.mapInArrow(run, picked.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))
