"""Main text by kinds of blocks: what is no article goes, whatever it holds; what stands in an article stays, whatever its form."""

import numpy as np
import pytest

from brambling.llm import htmlmain as hm
from brambling.llm import htmlmarked

WORDS = " ".join(["Ordinary words of a paragraph, as any."] * 10)
OUT = {
    "site header": "<header>{}</header>", "named header": '<div class="site-header">{}</div>', "comments": '<div class="comments">{}</div>', "comments by id": '<section id="comments">{}</section>', "comment list": '<ol class="comment-list"><li>{}</li></ol>',
    "aside": "<aside>{}</aside>", "sidebar": '<div class="sidebar">{}</div>', "form": "<form>{}</form>", "newsletter": '<div class="newsletter">{}</div>', "cookie notice": '<div class="cookie-notice">{}</div>', "notice": '<div id="notice">{}</div>',
    "advert": '<div class="advert">{}</div>', "ad": '<div class="ad">{}</div>', "footer": "<footer>{}</footer>", "nav": "<nav>{}</nav>", "menu": '<ul class="menu"><li>{}</li></ul>', "script": "<script>{}</script>", "style": "<style>{}</style>", "comment": "<!-- {} -->",
}
IN = {
    "bullets": "<ul><li>{0}</li><li>{1}</li></ul>", "numbers": "<ol><li>{0}</li><li>{1}</li></ol>", "table": "<table><tr><th>{0}</th><td>{1}</td></tr></table>", "quote": "<blockquote>{0} {1}</blockquote>", "quoted paragraph": "<blockquote><p>{0} {1}</p></blockquote>",
    "code": "<pre><code>{0} {1}</code></pre>", "caption": '<figure><img src="x"><figcaption>{0} {1}</figcaption></figure>', "terms": "<dl><dt>{0}</dt><dd>{1}</dd></dl>", "heading": "<h2>{0} {1}</h2>", "section": "<section><h2>{0}</h2><p>{1}</p></section>", "links": '<p><a href="x">{0}</a> {1}</p>',
}
AROUND = ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<div>{}</div>"]


@pytest.fixture(scope="module", params=[40, 300])
def model(spark, request):
    """Fits on two samples."""
    return hm.fit_pages(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), sample=request.param)


@pytest.mark.parametrize("around", AROUND)
def test_what_is_no_article_goes(model, around):
    for name, form in OUT.items():
        for where in ("before", "after", "inside"):
            if where == "inside" and "header" in name:
                continue
            for n in (1, 3):
                other = form.format("".join(f"<p>{WORDS} GONE{k}</p>" for k in range(n)))
                inside = f"<h1>A title</h1><p>{WORDS} ONE</p>{other if where == 'inside' else ''}<p>{WORDS} TWO</p><p>short.</p>"
                page = f"<html><body>{other if where == 'before' else ''}{around.format(inside)}{other if where == 'after' else ''}</body></html>"
                assert hm.extract(page, model) == f"A title {WORDS} ONE {WORDS} TWO short.", (name, where, n)


@pytest.mark.parametrize("around", AROUND)
def test_what_stands_in_an_article_stays(model, around):
    for name, form in IN.items():
        for size in ("", WORDS + " "):
            inside = f"<h1>A title</h1><p>{WORDS} ONE</p>{form.format(size + 'THIS', size + 'THAT')}<p>{WORDS} TWO</p>"
            page = f"<html><body><nav><ul><li><a href='x'>Menu</a></li></ul></nav>{around.format(inside)}<footer>Foot</footer></body></html>"
            assert hm.extract(page, model) == f"A title {WORDS} ONE {size}THIS {size}THAT {WORDS} TWO", (name, size)


def test_plain_blocks_outside_the_article(model):
    for after in ("<div><p>{}</p></div>", "<section><h2>Replies</h2><p>{}</p></section>"):
        page = f"<article><header><h1>A title</h1></header><p>{WORDS}</p></article>{after.format(WORDS + ' GONE')}"
        assert hm.extract(page, model) == f"A title {WORDS}"


def test_marked_pages_are_learned(model):
    wrong = total = 0
    for seed in range(200):
        page = hm.Page(htmlmarked.marked_page([WORDS], 10_000_000 + seed))
        want = hm.marked_labels(page)
        wrong, total = wrong + ((model.score(hm.node_features(page)) >= 0) != (want > 0)).sum(), total + len(want)
    assert wrong < 0.01 * total


def test_marks_never_reach_the_features():
    page = hm.Page(htmlmarked.marked_page([WORDS], 1))
    hm.marked_labels(page)
    assert not any({htmlmarked.KEEP, htmlmarked.DROP} & set(t) for t in page.tokens)
    assert htmlmarked.marked_page([WORDS], 5) == htmlmarked.marked_page([WORDS], 5) and "text" in htmlmarked.marked_page([], 6)


def test_trees_use_attribute_words(model):
    first, last = len(hm.GROUPS), len(hm.GROUPS) + hm.TOKEN_BUCKETS
    used = {f % (hm.N_FEATURES - hm.NUMBERS >> 1) for feature, _, _ in model.trees for level in feature for f in level if f < hm.N_FEATURES - hm.NUMBERS}
    assert any(first <= f < last for f in used)


def test_boosting_of_yes_and_no():
    rng = np.random.default_rng(1)
    x = np.c_[rng.random((4000, 3)) < 0.5, rng.random(4000)].astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    assert (((hm.BoostedTrees(x, y).score(x) >= 0) == (y > 0)).mean()) > 0.97  # cuts are 32nds
