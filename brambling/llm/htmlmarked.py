"""Marked pages for the fit of operator 7: pages put together from the texts of fitted ones, whose blocks say whether they are article.

The pages that a table gives show few of the kinds of blocks that pages have. Here texts of their articles are laid out
anew: in paragraphs, lists, tables, quotes, code, captions and headings of an article, and, as ordinary paragraphs,
lists and links too, in what is none: menus, site headers and footers, sidebars, notices, adverts, forms and
readers' comments, inside and outside the article, told by their tags or by the words of their attributes. Nothing but
tags, attributes and places tells the two apart, as both hold the same texts.
"""

from __future__ import annotations

import html
import random

KEEP, DROP = "zzkeep", "zzdrop"

# Words in the attributes of blocks, by what the blocks are.
ARTICLE_NAMES = ["article", "post", "entry", "content", "story", "body", "text", "main", "post-content", "entry-content", "article-body", "page-content"]
KINDS = {
    "nav": (["nav", "div", "ul"], ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "main-menu", "tabs"]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "topbar", "branding", "page-header", "logo"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "colophon", "copyright", "legal", "contentinfo", "bottom"]),
    "aside": (["aside", "div", "section"], ["sidebar", "aside", "widget", "rail", "complementary", "side", "related", "related-posts", "recommended", "popular", "trending"]),
    "notice": (["div", "section", "p"], ["cookie-notice", "cookie", "cookies", "consent", "gdpr", "banner", "notice", "alert", "popup", "modal", "dialog", "overlay", "paywall", "message"]),
    "advert": (["div", "section", "p"], ["ad", "ads", "advert", "advertisement", "adsense", "sponsored", "sponsor", "promo", "promotion", "banner-ad", "ad-slot"]),
    "form": (["form", "div"], ["newsletter", "subscribe", "signup", "login", "search-form", "contact-form", "register", "subscription", "form", "search"]),
    "comments": (["section", "div", "ul", "ol"], ["comments", "comment", "comment-list", "reader-comments", "disqus", "responses", "discussion", "replies", "commentary-thread", "comments-area"]),
    "share": (["div", "p"], ["share", "social", "sharing", "share-buttons", "follow", "tags"]),
}
#: Kinds whose first tag alone says what they are, and kinds that are told by standing outside the article's own element.
BY_TAG, OUTSIDE = ("nav", "header", "footer", "aside", "form"), ("notice", "advert", "comments", "share")
INNER = ("advert", "aside", "nav", "form", "share", "comments", "footer", "notice")


class _Layout:
    def __init__(self, texts: list[str], rng: random.Random) -> None:
        self.words = [w for t in texts for w in t.split()] or ["text"]
        self.rng = rng

    def some(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        at = self.rng.randrange(len(self.words))
        return html.escape(" ".join((self.words * 2)[at : at + n]), quote=False)

    def sized(self) -> str:
        return self.some(*self.rng.choice(((1, 4), (3, 12), (10, 40), (30, 120), (60, 80))))

    def link(self) -> str:
        return f'<a href="/{self.rng.randrange(99)}">{self.some(1, 4)}</a>'

    def mark(self, tag: str, inside: str, keep: bool, names: str = "", how: str = "class") -> str:
        other = f' {how}="{names}"' if names and how != "class" else ""
        classes = f"{names} {KEEP if keep else DROP}" if how == "class" and names else KEEP if keep else DROP
        return f'<{tag} class="{classes}"{other}>{inside}</{tag}>'

    def rows(self, tag: str, cell, keep: bool, low: int = 1, high: int = 6) -> str:
        return "".join(self.mark(tag, cell(), keep) for _ in range(self.rng.randint(low, high)))

    def block(self, keep: bool) -> str:
        """One block of any of the kinds of which texts are made, wherever they stand."""
        r, m = self.rng, self.mark
        kind = r.choice(("p",) * 6 + ("h2", "list", "list", "table", "quote", "code", "figure", "terms", "nest", "bare"))
        if kind == "p":
            return m("p", self.sized() + (f" {self.link()} {self.some(1, 9)}" if r.random() < 0.2 else ""), keep)
        if kind == "h2":
            return m(r.choice(("h2", "h3", "h4")), self.some(1, 9), keep)
        if kind == "list":
            cell = lambda: self.sized() if r.random() < 0.8 else m("p", self.sized(), keep)
            if r.random() < 0.15:
                cell = lambda: self.link() + (" " + self.some(1, 9) if r.random() < 0.5 else "")
            return m(r.choice(("ul", "ol")), self.rows("li", cell, keep, 1, 8), keep)
        if kind == "table":
            head = m("thead", m("tr", self.rows("th", lambda: self.some(1, 3), keep, 2, 4), keep), keep) if r.random() < 0.5 else ""
            body = self.rows("tr", lambda: self.rows("td", self.sized, keep, 1, 4), keep)
            caption = m("caption", self.some(1, 30), keep) if r.random() < 0.3 else ""
            return m("table", caption + head + (m("tbody", body, keep) if r.random() < 0.5 else body), keep)
        if kind == "quote":
            return m("blockquote", self.sized() if r.random() < 0.4 else self.rows("p", self.sized, keep, 1, 2), keep)
        if kind == "code":
            return m("pre", self.sized() if r.random() < 0.5 else f"<code>{self.sized()}</code>", keep)
        if kind == "figure":
            return m("figure", '<img src="x.png">' + m("figcaption", self.sized(), keep), keep)
        if kind == "terms":
            return m("dl", "".join(m("dt", self.some(1, 4), keep) + m("dd", self.sized(), keep) for _ in range(r.randint(1, 4))), keep)
        if kind == "nest":
            return m(r.choice(("div", "section")), "".join(self.block(keep) for _ in range(r.randint(1, 3))), keep, r.choice(("", "", "row", "section", "wrapper", "inner")))
        return m("div", self.sized(), keep)

    def other(self, kind: str, named: bool) -> str:
        """A block that is no article, with ordinary texts or with links in it."""
        r, (tags, names) = self.rng, KINDS[kind]
        tag, name = (r.choice(tags), r.choice(names)) if named else (tags[0], "")
        if tag in ("ul", "ol"):
            inside = self.rows("li", self.link if kind == "nav" else self.sized, False)
        elif tag == "p":
            inside = self.sized()
        elif kind == "nav" and r.random() < 0.7:
            inside = self.mark("ul", self.rows("li", self.link, False, 2, 9), False)
        elif r.random() < 0.35:
            inside = self.sized()
        else:
            inside = "".join(self.block(False) for _ in range(r.randint(1, 4)))
        if kind == "form" and r.random() < 0.7:
            inside += "<input name=q>" + self.mark("button", self.some(1, 2), False)
        return self.mark(tag, inside, False, name, r.choice(("class", "class", "id")) if named else "class")

    def page(self) -> str:
        r = self.rng
        shape = r.choice(("article", "article", "main", "main-article", "div", "div", "section", "bare"))
        marked = shape in ("article", "main", "main-article")
        blocks = [self.block(True) for _ in range(r.choice((1, 2, 4, 6, 9)))]
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            inner = r.choice(INNER)
            blocks.insert(r.randint(0, len(blocks)), self.other(inner, inner not in BY_TAG or r.random() < 0.6))
        if r.random() < 0.8:
            title = self.mark("h1", self.some(2, 14), True)
            byline = self.mark("p", self.some(2, 9), True) if r.random() < 0.4 else ""
            blocks.insert(0, self.mark("header", title + byline, True) if marked and r.random() < 0.3 else title + byline)
        inside, name = "".join(blocks), r.choice(ARTICLE_NAMES) if r.random() < 0.5 else ""
        body = {
            "article": lambda: self.mark("article", inside, True, name), "main": lambda: self.mark("main", inside, True, name), "main-article": lambda: self.mark("main", self.mark("article", inside, True, name), True),
            "div": lambda: self.mark("div", inside, True, name, r.choice(("class", "id"))), "section": lambda: self.mark("section", inside, True, name), "bare": lambda: inside,
        }[shape]()
        wanted = [k for k in ("header", "nav", "notice", "advert", "share") if r.random() < 0.4]
        before = "".join(self.other(k, self._named(k, marked)) for k in wanted)
        wanted = [k for k in ("comments", "aside", "advert", "form", "notice", "share", "footer") if r.random() < 0.4]
        r.shuffle(wanted)
        after = "".join(self.other(k, self._named(k, marked)) for k in wanted)
        whole = before + body + after
        if r.random() < 0.3:
            whole = self.mark("div", whole, True, r.choice(("", "wrapper", "container", "page", "layout")))
        return f"<html><body>{whole}</body></html>"

    def _named(self, kind: str, marked: bool) -> bool:
        """Whether attributes must say what a block is: not where its tag does, or its place outside the article's own element."""
        return self.rng.random() < 0.6 or not (kind in BY_TAG or (marked and kind in OUTSIDE))


def marked_page(texts: list[str], seed: int) -> str:
    """A page of the given texts, every block of which holds KEEP or DROP in its class."""
    return _Layout(texts, random.Random(seed)).page()
