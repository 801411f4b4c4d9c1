"""Operator 7: main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into block elements (inline markup belongs to the block around it). Each block gets
features: its tag and attribute tokens, depth, text, links and tags of its subtree, density, and how
it stands among its siblings. Boosted trees, fitted here on a bounded sample of pages
(``FIT_PAGES`` of least hash, equal pages once), give the probability that it is part of the article. The labels of the
fit come from pages that say themselves where their article is, and from ``MARKED`` pages that
are laid out anew from their texts (``htmlmarked``), so that every kind of block is learned, in articles and
outside. Decoding is hierarchical: the most
likely choice in which whatever is kept has kept ancestors, found bottom-up for whole subtrees, so a
kept paragraph in a dropped menu, or the reverse, can't come out.

Text is every kept block's own text in page order, character references decoded, white space turned
into single spaces. Scripts, styles, comments and the head never count.

Nulls and edges: null or empty html gives empty text; a null url or id stays null; very long pages are
read whole, in time that grows with their length, and from the first tag on whose quotes never end, tags
end at the next '>'; unclosed and stray tags are repaired as browsers
do for paragraphs, list items and cells; a page without any recognised block gives all its text; ties
in a score keep the block; repeated rows stay; with no page to learn from, all visible text is kept;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sample_by_hash, table, tune
from .htmlmarked import ARTICLE_NAMES, DROP, KEEP, KINDS, marked_page

FIT_PAGES, MARKED = 300, 1200
#: Of the longest fitted pages so many characters at most are laid out anew.
MARKED_CHARS = 20_000
TREES, DEPTH, RATE, BINS = 50, 5, 0.3, 32
#: Attribute words that marked pages use have a feature each, others share so many by their hash.
OTHER_TOKENS = 64

# How elements behave in HTML.
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg select".split())
SAME_CLOSES = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
GROUPS = ["p", "h1", "h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "header hgroup", "footer", "aside", "form fieldset button", "article main", "section", "div center", "table tbody thead tr td th", "blockquote pre figure figcaption", "html body"]
GROUP_OF = {t: k for k, g in enumerate(GROUPS) for t in g.split()}
# What pages call the parts that are no article (used for the labels of the fit only).
NOT_ARTICLE = set("nav header footer aside form".split())
STEMS = "comment sidebar cookie consent advert sponsor promo footer header nav menu newsletter subscri login share social related banner breadcrumb widget popup modal content article".split()
NOT_ARTICLE_TOKENS = set("ad ads advert advertisement banner sponsor promo sidebar menu navbar breadcrumb cookie consent notice comment comments share social related newsletter subscribe".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_CLOSE = {name: re.compile(f"</{name}\\s*>", re.I) for name in RAW} | {"head": re.compile(r"</head\s*>|(?=<body)", re.I)}
_ATTR = re.compile(r"(?:\b(?:class|id|role))\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")


def _tokens(attributes: str) -> frozenset[str]:
    """Words of class, id and role, and the stems that longer words hold."""
    words = {w.lower() for a in _ATTR.findall(attributes) for w in _WORD.findall("".join(a))}
    return frozenset(words | {f"~{x}" for w in words if len(w) > 3 for x in STEMS if x in w and w not in (KEEP, DROP)})


class Page:
    """Block elements in page order, and the pieces of text with the block each belongs to."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.depths, self.tokens = ["#page"], [-1], [0], [frozenset()]
        self.inner = [0]  # inline tags and line breaks in the block itself
        self.pieces: list[tuple[int, str, bool]] = []  # block, text, in a link
        stack, links, at, quotes, last = [0], 0, 0, True, source.rfind(">")
        opened: Counter[str] = Counter()
        unclosed: set[str] = set()

        def close(k: int) -> None:
            opened.subtract(self.tags[x] for x in stack[k:])
            del stack[k:]

        while at < len(source):
            if source[at] != "<":
                end = source.find("<", at)
                end = len(source) if end < 0 else end
                self.pieces.append((stack[-1], html_lib.unescape(source[at:end]), links > 0))
                at = end
                continue
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                at = len(source) if end < 0 else end + 3
                continue
            m = _NAME.match(source, at) if at < last else None
            if m is None:
                if at < last and source[at + 1] in "!?":
                    at = source.find(">", at) + 1
                else:
                    self.pieces.append((stack[-1], "<", links > 0))
                    at += 1
                continue
            name, tail = m[2].lower(), _QUOTED.match(source, m.end()) if quotes else None
            quotes = tail is not None  # a page whose quotes don't end is read without them from there on
            at = tail.end() if tail else source.find(">", m.end()) + 1
            attributes = source[m.end() : at - 1]
            if m[1]:
                if name == "a":
                    links = max(0, links - 1)
                if name not in INLINE and name not in VOID and opened[name]:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[k]] == name:
                            close(k)
                            links = 0
                            break
                continue
            if name in RAW or name == "head":
                end = None if name in unclosed else _CLOSE[name].search(source, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(name)
                    at = at if name == "head" else len(source)
                continue
            if name in VOID:
                self.inner[stack[-1]] += 1
                if name in ("br", "hr"):
                    self.pieces.append((stack[-1], " ", False))
                continue
            if name in INLINE:
                self.inner[stack[-1]] += 1
                links += name == "a" and not attributes.rstrip().endswith("/")
                continue
            if self.tags[stack[-1]] == "p":
                close(len(stack) - 1)
                links = 0
            if name in SAME_CLOSES:
                like = next((x for x in ({"td", "th"}, {"dt", "dd"}) if name in x), {name})
                if any(opened[x] for x in like):
                    for k in range(len(stack) - 1, 0, -1):
                        t = self.tags[stack[k]]
                        if t in like:
                            close(k)
                            break
                        if t in SAME_CLOSES[name]:
                            break
            words = _tokens(attributes) if attributes else frozenset()
            self.parents.append(stack[-1])
            self.depths.append(len(stack))
            self.tags.append(name)
            self.tokens.append(words)
            self.inner.append(0)
            opened[name] += 1
            stack.append(len(self.tags) - 1)

    def text(self, keep: np.ndarray) -> str:
        out, before = [], None
        for block, text, _ in self.pieces:
            if block != before:
                out.append(" ")
                before = block
            if keep[block]:
                out.append(text)
        return " ".join("".join(out).split())


_NAMED = {w for names in [ARTICLE_NAMES, *(n for _, n in KINDS.values())] for name in names for w in _tokens(f'class="{name}"')}
TOKEN_OF = {w: k for k, w in enumerate(sorted(_NAMED | {f"~{x}" for x in STEMS}))}
#: Two features more: any word that names something else than an article, and any that names one.
_ARTICLE = {w for name in ARTICLE_NAMES for w in _tokens(f'class="{name}"')}
_ELSE = (set(TOKEN_OF) | NOT_ARTICLE_TOKENS) - _ARTICLE
TOKEN_BUCKETS = len(TOKEN_OF) + OTHER_TOKENS + 2


def _token_place(word: str) -> int:
    return TOKEN_OF[word] if word in TOKEN_OF else len(TOKEN_OF) + zlib.crc32(word.encode()) % OTHER_TOKENS


#: Own tag and tokens, those of the blocks around, and numbers.
NUMBERS = 17
N_FEATURES = 2 * (len(GROUPS) + TOKEN_BUCKETS) + NUMBERS


def node_features(page: Page) -> np.ndarray:
    """A row for every block."""
    n = len(page.tags)
    parents, depths = np.array(page.parents), np.array(page.depths, float)
    own, link, marks = np.zeros(n), np.zeros(n), np.zeros(n)
    for block, text, in_link in page.pieces:
        size = len(text) - text.count(" ")
        own[block] += size
        link[block] += size * in_link
        marks[block] += text.count(",") + text.count(".")
    total, links, tags, paragraphs, stops = own.copy(), link.copy(), 1.0 + np.array(page.inner), np.array([t == "p" for t in page.tags], float), marks.copy()
    for k in range(n - 1, 0, -1):  # children come after their parent
        for x in (total, links, tags, paragraphs, stops):
            x[parents[k]] += x[k]
    siblings: dict[int, list[int]] = {}
    for k in range(1, n):
        siblings.setdefault(page.parents[k], []).append(k)
    place, count, same, share = np.zeros(n), np.ones(n), np.ones(n), np.ones(n)
    for group in siblings.values():
        kinds: dict[str, int] = {}
        for k in group:
            kinds[page.tags[k]] = kinds.get(page.tags[k], 0) + 1
        whole = total[group].sum() + 1
        for j, k in enumerate(group):
            place[k], count[k], same[k], share[k] = j, len(group), kinds[page.tags[k]] / len(group), total[k] / whole
    x, named = np.zeros((n, N_FEATURES), np.float32), len(GROUPS) + TOKEN_BUCKETS
    for k, (tag, tokens) in enumerate(zip(page.tags, page.tokens)):
        if tag in GROUP_OF:
            x[k, GROUP_OF[tag]] = 1
        for w in tokens:
            x[k, len(GROUPS) + _token_place(w)] = 1
        if tokens:
            x[k, named - 2 : named] = not _ELSE.isdisjoint(tokens), not _ARTICLE.isdisjoint(tokens)
        if k:
            np.maximum(x[parents[k], :named], x[parents[k], named : 2 * named], out=x[k, named : 2 * named])
    up, main = np.maximum(parents, 0), GROUP_OF["article"]
    holds = x[:, main].any() * 1.0
    within = np.maximum(x[:, main], x[:, named + main])
    x[:, -NUMBERS:] = np.c_[depths, np.log1p(own), np.log1p(total), links / (total + 1), np.log1p(tags), total / tags, stops / (total + 1), np.log1p(paragraphs), np.log1p(place), place / count, np.log1p(count), same, share, np.log1p(total[up]), links[up] / (total[up] + 1), np.full(n, holds), holds - within]
    return x


def marked_labels(page: Page) -> np.ndarray:
    """Labels of a page of ``htmlmarked``; its marks are taken away. A block around a kept one is kept, one without a mark is as its content."""
    n = len(page.tags)
    keep = np.array([KEEP in t for t in page.tokens])
    page.tokens = [t - {KEEP, DROP} for t in page.tokens]
    for k in range(n - 1, 0, -1):
        keep[page.parents[k]] |= keep[k]
    return keep.astype(float)


def own_labels(page: Page) -> np.ndarray | None:
    """1 for blocks in or around what the page marks as its article, 0 for others; nothing if it marks none."""
    n = len(page.tags)
    inside, bad = np.zeros(n, bool), np.zeros(n, bool)
    for k in range(1, n):
        up = page.parents[k]
        own = page.tags[k] in NOT_ARTICLE and not (page.tags[k] == "header" and inside[up])  # an article's header holds its title
        bad[k] = bad[up] or own or bool(page.tokens[k] & NOT_ARTICLE_TOKENS)
        inside[k] = (inside[up] or page.tags[k] in ("article", "main")) and not bad[k]
    if not inside.any():
        return None
    for k in range(n - 1, 0, -1):
        if inside[k]:
            inside[page.parents[k]] = True
    return inside.astype(float)


class BoostedTrees:
    """Newton boosting for a yes or no over binned features, every tree grown level by level to one depth."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> None:
        rate_of_yes = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.start, self.depth, self.trees = float(np.log(rate_of_yes / (1 - rate_of_yes))), depth, []
        if not len(y) or y.min() == y.max():
            self.start = 20.0  # nothing to tell apart: keep all
            return
        yes_no = np.array([set(np.unique(c)) <= {0.0, 1.0} for c in x.T])
        some, numeric = np.flatnonzero(yes_no & x.any(0)), np.flatnonzero(~yes_no)
        row, flag = np.nonzero(x[:, some])  # a feature of yes and no has one cut, and sums over the few that are yes
        cuts = {f: np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in numeric}
        binned = {f: np.searchsorted(cuts[f], x[:, f], side="left") for f in numeric}
        score = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            where, feature, cut = np.zeros(len(y), int), [], []
            for level in range(depth):
                nodes = 1 << level
                best, choice = np.full(nodes, 1e-9), [(0, np.inf)] * nodes
                gt, ht = (np.bincount(where, w, nodes)[:, None] for w in (g, h))
                gain_of = lambda gl, hl, gt=gt, ht=ht: gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                if len(some):
                    key = where[row] * len(some) + flag
                    gu, hu = (np.bincount(key, w[row], nodes * len(some)).reshape(nodes, -1) for w in (g, h))
                    gain = gain_of(gt - gu, ht - hu)
                    k = gain.argmax(1)
                    for node in np.flatnonzero(gain[np.arange(nodes), k] > best):
                        best[node], choice[node] = gain[node, k[node]], (int(some[k[node]]), 0.5)
                for f in numeric:
                    if not len(cuts[f]):
                        continue
                    key = where * (BINS + 1) + binned[f]
                    sg, sh = (np.bincount(key, w, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(1) for w in (g, h))
                    gain = gain_of(sg[:, : len(cuts[f])], sh[:, : len(cuts[f])])
                    k = gain.argmax(1)
                    for node in np.flatnonzero(gain[np.arange(nodes), k] > best):
                        best[node], choice[node] = gain[node, k[node]], (int(f), float(cuts[f][k[node]]))
                feature.append([c[0] for c in choice])
                cut.append([c[1] for c in choice])
                fs, cs = np.array(feature[-1])[where], np.array(cut[-1])[where]
                where = 2 * where + (x[np.arange(len(y)), fs] > cs)
            leaves = 1 << depth
            value = rate * np.bincount(where, g, leaves) / (np.bincount(where, h, leaves) + 1)
            self.trees.append((feature, cut, value))
            score += value[where]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            where = np.zeros(len(x), int)
            for f, c in zip(feature, cut):
                where = 2 * where + (x[rows, np.array(f)[where]] > np.array(c)[where])
            out += value[where]
        return out


def decode(parents: list[int], score: np.ndarray) -> np.ndarray:
    """The most likely blocks to keep of those choices that keep every ancestor of what they keep."""
    n = len(parents)
    keep, drop = -np.logaddexp(0, -score), -np.logaddexp(0, score)
    for k in range(n - 1, 0, -1):
        keep[parents[k]] += max(keep[k], drop[k])
        drop[parents[k]] += drop[k]
    out = np.zeros(n, bool)
    out[0] = True
    for k in range(1, n):
        out[k] = out[parents[k]] and keep[k] >= drop[k]
    return out


def _marked(page: Page, labels: np.ndarray, seed: int, copies: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of pages laid out anew from a page's article."""
    texts = "".join(t if labels[block] else " " for block, t, _ in page.pieces)[:MARKED_CHARS]
    for k in range(copies):
        made = Page(marked_page([texts], seed * copies + k))
        kept = marked_labels(made)
        yield node_features(made), kept


def fit_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample: int = FIT_PAGES, marked: int = MARKED) -> BoostedTrees:
    # The hashes are chosen first, from narrow rows; then only pages that have one of them are read for the fit.
    hashed = pages.filter(F.length(html_col) > 0).withColumn("_hm_h", F.xxhash64(id_col, html_col))
    chosen = sample_by_hash(hashed.select("_hm_h").distinct(), ["_hm_h"], sample)
    rows = hashed.join(F.broadcast(chosen), "_hm_h").groupBy("_hm_h").agg(F.first(html_col).alias("html")).orderBy("_hm_h").collect()
    x, y = [np.zeros((0, N_FEATURES), np.float32)], [np.zeros(0)]
    fitted = [(page, labels, r["_hm_h"] & 0xFFFFFFFF) for r in rows if (labels := own_labels(page := Page(r["html"]))) is not None]
    for page, labels, seed in fitted:
        for features, kept in [(node_features(page), labels), *_marked(page, labels, seed, -(-marked // len(fitted)))]:
            x.append(features)
            y.append(kept)
    return BoostedTrees(np.concatenate(x), np.concatenate(y))


def extract(source: str | None, model: BoostedTrees) -> str:
    if not source:
        return ""
    page = Page(source)
    return page.text(decode(page.parents, model.score(node_features(page))))


def extract_pages(pages: DataFrame, model: BoostedTrees, *, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [Page(x) if x else None for x in batch.column("html").to_pylist()]
            some = [p for p in parsed if p]
            x = [node_features(p) for p in some]
            scores = np.split(model.score(np.concatenate(x)), np.cumsum([len(a) for a in x])[:-1]) if some else []
            texts = iter([p.text(decode(p.parents, s)) for p, s in zip(some, scores)])
            texts = [next(texts) if p else "" for p in parsed]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, fit_pages(pages))
