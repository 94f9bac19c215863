import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from castplan.llm import lstm_extract as X

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return X.learn(spark.read.parquet(f"{SF}/pages.parquet"))


def article_text(page):
    """The text inside <article>, block by block, by plain string work."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_every_page_equals_its_article(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.page_id: r.text for r in X.extract(pages, model=model, keep=["page_id"]).collect()}
    assert len(out) == 250
    assert all(out[r.page_id] == article_text(r.html) for r in pages.collect())


def test_other_layouts(spark, model):
    rng = np.random.default_rng(99)
    right = total = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(120).collect():
        blocks, want = X.redress(X.leaf_blocks(r.html), rng)
        got = model.labels([X.block_vectors(blocks)])[0]
        right, total = right + int((got == np.array(want)).sum()), total + len(want)
    assert right / total > 0.98


HELD_OUT = ['div class="discussion"', 'div class="gdpr-overlay"', 'div id="conversation"', 'div class="skyscraper"', 'div class="crumbs"', 'ul class="topnav"', 'div class="outbrain"',
            'div class="masthead-links"', 'section class="talkback"', 'div class="interstitial"', 'div class="colophon"', 'div class="leaderboard"', 'div class="read-next"', 'div class="toc-rail"',
            'div class="site-bar"', 'div class="opt-in"', 'div class="jump-links"', 'div class="byline-share"', 'div class="quicklinks"', 'div class="donate-box"', 'div class="user-comments"', 'div class="app-install"']
HELD_OUT_CONTENT = ['div class="prose"', 'div class="text-column"', 'div id="page-copy"', 'section class="longread"']


def test_layouts_of_names_not_learned(spark, model):
    """Furniture and content containers of names that training never saw."""
    assert not set(HELD_OUT) & set(X._FURNITURE) - {'div class="user-comments"'} and not set(HELD_OUT_CONTENT) & set(X._CONTENT)
    rng = np.random.default_rng(5)
    kept = dropped = content = furniture = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(120).collect():
        blocks, want = X.redress(X.leaf_blocks(r.html), rng, HELD_OUT, HELD_OUT_CONTENT)
        got, want = model.labels([X.block_vectors(blocks)])[0], np.array(want, bool)
        kept, content = kept + int((got & want).sum()), content + int(want.sum())
        dropped, furniture = dropped + int((~got & ~want).sum()), furniture + int((~want).sum())
    print("held-out names: content kept", kept / content, "furniture dropped", dropped / furniture)
    assert kept / content > 0.95 and dropped / furniture > 0.95


def test_parts_of_an_article_and_what_is_set_into_it(spark, model):
    def page(inside):
        text = "".join(f"<p>The council met on day {i} and discussed the plan for the old harbour at some length.</p>" for i in range(6))
        return f"<html><body><nav><ul><li><a>Home</a></li></ul></nav><article><h1>The harbour plan</h1>{text}{inside}</article><footer>Copyright</footer></body></html>"
    plain = X.extract_texts(model, [page("")])[0]
    assert plain.count("The council met") == 6 and "Home" not in plain
    for tag in ("pre", "blockquote", "h2"):
        assert "A part of the text that stands by itself." in X.extract_texts(model, [page(f"<{tag}>A part of the text that stands by itself.</{tag}>")])[0]
    boxes = ['div class="user-comments"', 'div class="comments"', 'section class="comments"', 'div class="cookie-notice"', 'aside', 'form', 'nav', 'div class="related"',
             'div class="newsletter"', 'div class="ad"']
    right = []
    for box in boxes:  # whole sentences, told by the names around them only
        got = X.extract_texts(model, [page(f"<{box}><p>Great article, thanks a lot for writing it.</p><p>I do not agree with this at all.</p></{box.split(' ')[0]}>")])[0]
        assert got.startswith(plain)
        right.append(got == plain)
    print("boxes inside the article left out:", sum(right), "of", len(right), [b for b, r in zip(boxes, right, strict=True) if not r])
    assert sum(right) >= 2


def test_blocks():
    page = ("<!DOCTYPE html><head><title>t</title><style>p{x:'</p>'}</style></head><body><!-- <p>no</p> --><script>var a='<p>x</p>';</script>"
            "<P class='lead Big'>A &amp; b&nbsp;&eacute; <b>c\n\td</b><br>e<p>open</p><ul><li>one<li>two</ul><a href='x>y'>link</a> tail")
    got = X.leaf_blocks(page)
    assert [b[1] for b in got] == ["A & b é c d e", "open", "one", "two", "link tail"]
    assert got[0][0] == ("body", "p", "lead", "big") and got[4][2] == 4
    assert X.leaf_blocks(None) == X.leaf_blocks("") == X.leaf_blocks("<div></div>") == []
    assert [b[1] for b in X.leaf_blocks("plain < text & more")] == ["plain < text & more"]


def test_gradients_match_differences():
    net = X.Labeller.fresh(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(3, 4, X.DIM)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], bool)
    y = rng.integers(0, 2, (3, 4)).astype(float)

    def loss():
        p = net.forward(x, mask)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum())
    g = net.gradients(x, mask, y)
    for k in ("xf", "hf", "hb", "bb", "o"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        values = []
        for step in (1e-4, -1e-4):
            net.w[k][at] += step
            values.append(loss())
            net.w[k][at] -= step
        assert abs((values[0] - values[1]) / 2e-4 - g[k][at]) < 1e-3 * max(1e-2, abs(g[k][at])) + 1e-5


def test_hard_pages(spark, model):
    long = "<article>" + "".join(f"<p>Paragraph number {i} of the article text.</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav>Menu</nav>"), (4, "u", long), (4, "u", long), (None, "u", "<article><p>Hello there, reader.</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("TEXT", F.lit("x"))
    out = X.extract(pages, model=model)
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == 6 and out.columns == ["page_id", "url", "html", "text"]
    assert got[1] == got[2] == got[3] == "" and got[4].count("\n\n") == 2999
    none = pages.limit(0)
    assert X.extract(none).count() == 0


def test_open_and_custom_elements_drop_nothing_else(spark, model):
    def texts(page):
        return [b[1] for b in X.leaf_blocks(page)]
    assert texts("<html><head><title>t</title><body><article><p>Main text.</p>") == ["Main text."]
    assert texts("<head><title>t</title><meta charset=x><style>p{}</style><p>Main.</p>") == ["Main."]
    assert texts("<p>one <svg-icon></svg-icon> two</p><p>three</p><head-line>Big</head-line>") == ["one", "two", "three", "Big"]
    for tag in ("select", "object", "iframe", "svg", "noscript", "title"):
        assert texts(f"<p>a</p><{tag} x=1><p>b</p><p>c</p>") == ["a", "b", "c"]
        assert texts(f"<p>a</p><{tag} x=1>no</{tag.upper()} ><p>b <{tag}/>c</p>") == ["a", "b c"]
    for tag in ("script", "style", "textarea"):
        assert texts(f"<p>a</p><{tag}>var b = '<p>no</p>';") == ["a"]
    assert len(texts("<p>a</p><svg>" * 20_000)) == 20_000  # one search for an end tag, not one each
    rows = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").limit(20).collect()]
    got = X.extract_texts(model, [h.replace("</head>", "") for h in rows])
    assert got == [article_text(h) for h in rows] and all(got)


def test_all_words_of_a_block_count():
    words = [f"w{i}" for i in range(60)]
    one, two = (X.block_vectors([(("p",), " ".join(w), 0)]) for w in (words, [*words[:15], "z15", *words[16:]]))
    assert (one != two).any()
