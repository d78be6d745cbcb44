import random

import numpy as np
import pytest

from attesta.llm.html_blocks import blocks
from attesta.llm.html_extraction import BlockLabeller, extract, main_texts, padded, practice_page, practice_pages, train, vectors


def test_blocks_are_whole_and_in_order():
    got = blocks('<html><head><title>no</title><script>var t="</p>";</script></head><body><nav class="Top menu"><a href="x">A&amp;B</a></nav>'
                 '<!-- no --><p>one<b> two\n <br>three<p>four &eacute;&#8364;&nbsp;x</p>tail <style>no</style>end<ul><li>a<li>b</ul><p>open &amp')
    assert [t for _, t, _ in got] == ["A&B", "one two three", "four é€ x", "tail end", "a", "b", "open &"]
    assert got[0][0] == ("html", "body", "nav", ".top", ".menu", "a") and got[0][2] == 3
    assert blocks(None) == blocks("") == blocks("<p> <br></p>") == []
    assert [t for _, t, _ in blocks("plain text")] == ["plain text"]


def test_gradient_matches_differences():
    rng = np.random.default_rng(3)
    model = BlockLabeller(hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = padded([v for v, _ in practice_pages(3, 1)])
    y = (rng.random(mask.shape) < 0.5).astype(np.float64)
    x, mask = x.astype(np.float64), mask.astype(np.float64)
    _, grad = model.gradient(x, mask, y)
    for key, value in model.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape) if key not in ("xl", "xr", "skip") else (int(np.argmax(x.sum((0, 1)))), 0)
        old, step = value[at], 1e-4
        value[at] = old + step
        up, _ = model.gradient(x, mask, y)
        value[at] = old - step
        down, _ = model.gradient(x, mask, y)
        value[at] = old
        assert grad[key][at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_unseen_practice_pages():
    pages = practice_pages(150, 99)
    wrong = sum((a != b).sum() for a, (_, b) in zip(train().label([v for v, _ in pages]), pages))
    assert wrong <= 0.02 * sum(len(b) for _, b in pages)


def test_batching_changes_nothing():
    model, pages = train(), [v for v, _ in practice_pages(20, 4)] + [np.zeros((0, 452), np.float32)]
    for a, b in zip(model.label(pages), model.label(pages, most_cells=1)):
        assert (a == b).all()


def test_page_with_side_parts():
    html = ('<body><header><div class="logo">Site</div></header><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
            '<div class="cookie-notice">We use cookies. <button>Accept</button></div>'
            "<article><h1>Title here</h1><p>First long paragraph of the text, with words.</p><p>Second &lt;one&gt;  follows.</p></article>"
            '<div class="comments"><p>Nice post, thanks.</p></div><footer>&copy; all rights</footer>')
    assert main_texts([html], train()) == ["Title here\nFirst long paragraph of the text, with words.\nSecond <one> follows."]


LAYOUTS = {
    "names on plain elements": ('<body><div id="header"><h1>My Site</h1><ul class="menu"><li><a href=1>Home</a><li><a href=2>About us</a></ul></div><div id="content">'
                                '<h2>A day at the lake</h2><p>The water was calm and the birds sang. We sat there for hours.</p></div><div id="sidebar"><h3>Recent posts</h3>'
                                '<ul><li><a href=3>One</a><li><a href=4>Two</a></ul></div><div id="footer">Copyright 2024 My Site</div>',
                                "A day at the lake\nThe water was calm and the birds sang. We sat there for hours."),
    "comments in main": ('<body><header><a href="/">Logo</a></header><main><article><h1>Title of it</h1><p>First paragraph of real text goes here, with several words.</p>'
                         '<aside class="ad">Buy now!</aside><p>Second paragraph of real text.</p></article><section id="comments"><h2>Comments</h2><div class="comment">'
                         "<p>Great article, thanks a lot!</p></div></section></main><footer><p>Terms and privacy</p></footer>",
                         "Title of it\nFirst paragraph of real text goes here, with several words.\nSecond paragraph of real text."),
    "notice and form inside": ('<body><nav><ul><li><a href=1>x</a></li></ul></nav><article><div class="notice">This page moved.</div><h1>Head</h1><p>Real text in the article body.</p>'
                               '<form><input><button>Send</button></form><p>More real text in the body.</p></article><div class="ad">Ad text here now.</div><footer>f</footer>',
                               "Head\nReal text in the article body.\nMore real text in the body."),
    "no names at all": ("<body><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><h1>Some headline</h1><p>Long text follows in this place, with many words and a full stop.</p>"
                        "<p>Another paragraph that goes on for a while, as they do.</p><p><a href=9>Imprint</a> <a href=8>Contact</a></p>",
                        "Some headline\nLong text follows in this place, with many words and a full stop.\nAnother paragraph that goes on for a while, as they do."),
}


@pytest.mark.parametrize("kind", LAYOUTS)
def test_layouts(kind):
    assert main_texts([LAYOUTS[kind][0]], train()) == [LAYOUTS[kind][1]]


def test_rows_of_any_kind(spark):
    rng = random.Random(1)
    long = "<article>" + "".join(f"<p>Sentence number {i} of the article text.</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", None, "z"), (2, None, "", "z"), (3, "u", practice_page(rng)[0], "z"), (3, "u", "<p>" * 2000 + "x", "z"), (None, "u", long, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[None].count("\n") == 2999
    assert extract(df.limit(0)).count() == 0


def test_vectors_are_finite():
    assert np.isfinite(vectors(blocks("<p>a</p><div>b c</div>"))).all()


@pytest.mark.parametrize("head", ["<head><title>no</title><meta charset=utf-8><style>p{}</style>", "<head><script>1</script><noscript><img src=x></noscript>", "<head>",
                                  "<head><noscript><link rel=x>"])
def test_a_head_without_its_end_tag(head):
    rest = "<nav><a href=1>Home</a></nav><p>one</p><p>two"
    want = blocks(f"<html><head></head><body>{rest}")
    assert [t for _, t, _ in want] == ["Home", "one", "two"] and blocks(f"<html>{head}<body>{rest}") == want
    if "<noscript><link" not in head:
        assert [t for _, t, _ in blocks(f"<html>{head}{rest}")] == ["Home", "one", "two"]
        assert [t for _, t, _ in blocks(f"<html>{head}\n <br>plain {rest}")] == ["plain", "Home", "one", "two"]
        assert [t for _, t, _ in blocks(f"<html>{head}plain {rest}")] == ["plain", "Home", "one", "two"]
    assert blocks("<head><template><p>x</p></template><title>y</title>") == []


def test_omitted_head_end_keeps_the_article():
    page = LAYOUTS["comments in main"]
    for head in ("<!DOCTYPE html><html><head><title>t</title>", "<title>t</title>"):
        assert main_texts([head + page[0], head + page[0].removeprefix("<body>")], train()) == [page[1]] * 2


def test_a_block_that_begins_with_a_break_has_its_own_path():
    got = blocks('<body><div class="sidebar">side</div><article><p><br> <br>text<br>more</p></article><div class="foot"><span><br></span><b>end</b></div>')
    assert [(p[1:], t) for p, t, _ in got] == [(("div", ".sidebar"), "side"), (("article", "p"), "text more"), (("div", ".foot", "b"), "end")]


def test_all_words_of_a_block_are_seen():
    start = " ".join(["one"] * 30)
    a, b = (vectors([(("p",), f"{start} {last}.", 0)]) for last in ("cookies", "gardens"))
    assert (a != b).any()
