"""HTML extraction on layouts with known main text."""

import random

import pytest

from lamella.llm import html, layouts
from tests.llm.helpers import LONG, clashing

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head>"
CASES = {
    "article": (HEAD + '<body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head</h1><p><b>One two.<br><p>Three &amp; four.</p><p>Of.</p></article><footer>&copy; x</footer>', "Head\n\nOne two.\n\nThree & four.\n\nOf."),
    "sidebar and comments": ('<body><div id="cookie-notice">We use cookies</div><div class="wrap"><div class="content"><h1>Title here</h1><p>Para one<div class="ad-slot">Buy now</div><p>Para&nbsp;three</p><ul><li>a<li>b</ul></div><div class="sidebar"><p>side text long enough to matter</p></div></div><section id="comments"><p>I agree</p></section></body>', "Title here\n\nPara one\n\nPara three\n\na\n\nb"),
    "nested furniture": ("<body><header><h1>Site</h1></header><main><article><header><h1>Head</h1></header><p>Text</p><aside>pull</aside><form><input>Subscribe</form><p>End.</p></article><section class='comments'><p>a reader says</p></section></main><footer>f</footer>", "Head\n\nText\n\nEnd."),
    "plain": ("<p>Just   this\n text</p>", "Just this text"),
    "no markup": ("only words &lt;here&gt;", "only words <here>"),
    "comment and quotes": ('<body><!-- <p>no</p> --><p title="a > b">yes</p></body>', "yes"),
    "references": ("<p>&eacute;&#233;&#x1F600; &qqq; a&ltb</p>", "éé😀 &qqq; a<b"),
    "stray ends": ("</div></p><article><p>in</p></section><p>still</article></article>", "in\n\nstill"),
    "table": ("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></article>", "a b\n\nc"),
    "only furniture": ("<body><nav>a</nav><footer>b</footer></body>", ""),
    "open script": ("<p>x</p><script>never ends <p>y</p>", "x"),
    "layout names": ('<body class="has-sidebar"><div class="page with-sidebar"><div class="post"><div class="entry-header"><h1>Head</h1></div><p>Text here.</p></div><div class="left sidebar"><p>links and more</p></div></div>', "Head\n\nText here."),
    "comment articles": ('<main><article><p>The story.</p></article><div class="comments"><article><p>me too</p></article></div></main>', "The story."),
    "hidden": ('<article><p>seen</p><p style="display: none">not</p><div hidden>nor</div></article>', "seen"),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    page, want = CASES[name]
    assert html.main_text(page) == want


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>'])
def test_linked_content_stays(frame):
    content = '<h1><a href="/x">A headline</a></h1><p>Some text of it.</p><p><a href="/y">A source</a></p><ul><li><a href="/z">A reference</a></li></ul><p>The end.</p>'
    page = f'<body><nav><a href="/">Home</a></nav>{frame.format(content)}<footer><a href="/i">Imprint</a></footer></body>'
    assert html.main_text(page) == "A headline\n\nSome text of it.\n\nA source\n\nA reference\n\nThe end."


#: Markup that ordinary pages hold: all of the article stays, whatever sites call its parts.
FRAME = "<body><nav><a href='/'>Home</a></nav>%s<footer>f</footer></body>"
ORDINARY = {
    'links': (FRAME % "<article><h1>T</h1><p>Some words here.</p><ul><li><a href='/a'>A link</a></li><li><a href='/b'>Another</a></li></ul><p>End of it.</p></article>","T\n\nSome words here.\n\nA link\n\nAnother\n\nEnd of it."),
    'math': (FRAME % "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be it.</p></article>","Let x=1 be it."),
    'related-work': (FRAME % "<article><h1>T</h1><section class='related-work'><p>Others did this.</p></section><p>End.</p></article>","T\n\nOthers did this.\n\nEnd."),
    'social': (FRAME % "<article><h1>T</h1><p class='social-history'>Short one.</p><p>End.</p></article>","T\n\nShort one.\n\nEnd."),
    'legal in': (FRAME % "<article><h1>T</h1><div class='legal'><p>Of the law.</p></div><p>End.</p></article>","T\n\nOf the law.\n\nEnd."),
    'legal around': (FRAME % "<div class='legal'><article><h1>T</h1><p>Of the law.</p></article></div>","T\n\nOf the law."),
    'post meta around': (FRAME % "<div class='post meta'><article><h1>T</h1><p>Of the law.</p></article></div>","T\n\nOf the law."),
    'menus': ("<body><article><p>one two three</p>"+"<nav><ul><li><a href='/'>x</a></li></ul></nav>"*20+"<p>four five six</p></article></body>","one two three\n\nfour five six"),
    'menus2': ("<body><div class='content'><p>one two three</p>"+"<nav><ul><li><a href='/'>x</a></li></ul></nav>"*20+"<p>four five six</p></div></body>","one two three\n\nfour five six"),
    'menus3': ("<body><p>one two three</p>"+"<nav><ul><li><a href='/'>x</a></li></ul></nav>"*20+"<p>four five six</p></body>","one two three\n\nfour five six"),
    'one link': (FRAME % "<article><h1>T</h1><p><a href='/x'>All of this is a link</a></p></article>","T\n\nAll of this is a link"),
    'comments': (FRAME % "<article><h1>T</h1><p>x y.</p></article><div id='comments'><h2>2 comments</h2><p>I do not agree with this at all, it is very long and has many words.</p></div>","T\n\nx y."),
    'cookie': ("<body><div class='cookie-bar'>We use cookies to make this site better for you and all</div><main><h1>T</h1><p>x y.</p></main></body>","T\n\nx y."),
    'cookiepara': ("<body><div id='cookie-consent-popup'><p>We use cookies to make this site better for you and all</p></div><div class='body'><h1>T</h1><p>x y.</p></div></body>","T\n\nx y."),
    'in ad': ("<body><article><h1>T</h1><p>x y.</p><div class='ad'><p>Buy this now and you will not be sorry at all today</p></div><p>z.</p><div class='newsletter'><p>Sign up to get our best stories each day in your mail</p></div></article></body>","T\n\nx y.\n\nz."),
    'table': (FRAME % "<article><table><tr><td>a</td><td>b</td></tr></table><dl><dt>t</dt><dd>d</dd></dl><pre>x  y</pre></article>","a b\n\nt\n\nd\n\nx y"),
    'discussion': (FRAME % "<article><h1>T</h1><section class='discussion'><h2>Discussion</h2><p>Long words.</p></section></article>","T\n\nDiscussion\n\nLong words."),
    'h-only': (FRAME % "<article><h1>T</h1></article>","T"),
    'article-header byline': (FRAME % "<article><header><h1>T</h1><p class='byline'>By me</p></header><p>x</p><footer>Tags: a</footer></article>","T\n\nx"),
    'pager in main': ("<body><main><h1>T</h1><p>x</p><div class='pagination'><a href='/2'>Next</a></div></main></body>","T\n\nx"),
}


@pytest.mark.parametrize("name", ORDINARY)
def test_ordinary_articles_are_whole(name):
    page, want = ORDINARY[name]
    assert html.main_text(page) == want


def test_words_score_by_their_context_and_tags_below_zero():
    w = html.weights()
    assert all(w[f] < -2 for f in ("nav", "footer", "aside", "form", ".sidebar", ".comments", "~ad", "beside"))
    assert all(w[f] > 0 for f in ("inside", "heading", "blockquote", ".content", ".related-work"))
    assert all(v <= 0 for f, v in w.items() if f.startswith("<")) and w["<nav"] < w["<p"] < 0


def blocks_right(pages, w):
    """The share of blocks whose side is right, by words."""
    found = [((b.score > 0) == b.text.startswith(mark), b.words) for page, mark in pages for b in html.blocks(page, w)]
    return sum(n for ok, n in found if ok) / sum(n for _, n in found)


@pytest.mark.parametrize("part", range(4))
def test_held_out_pages(part):
    pages = layouts.pages()
    held = pages[part::4]
    w = html.learned([p for i, p in enumerate(pages) if i % 4 != part])
    assert blocks_right(held, w) > 0.97


@pytest.mark.parametrize("frame", range(0, len(layouts.FRAMES), 3))
def test_a_frame_never_seen(frame):
    out = layouts.filled(layouts.FRAMES[frame].replace("{}", layouts.CONTENT[0]))
    seen = [p for p in layouts.pages() if layouts.filled(layouts.FRAMES[frame].split("{}")[0]) not in p[0] or layouts.FRAMES[frame] in ("{}", "<div>{}</div>", "<section>{}</section>")]
    page = "<body><nav><a href='/'>Home</a></nav>" + out + "<footer>end</footer></body>"
    text = html.main_text(page, html.learned(seen))
    assert text.count(layouts.MARK) >= 0.95 * out.count(layouts.MARK) and "Home" not in text and "end" not in text


def test_best_run_against_all_runs():
    rng = random.Random(5)
    for _ in range(400):
        scores = [rng.choice([-3.0, -1.5, -0.5, 0.0, 0.5, 1.0, 4.0]) for _ in range(rng.randint(0, 12))]
        start, end = html.best_run(scores)
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        best = max(sums.values(), default=0.0)
        assert (start, end) == (0, 0) if best <= 0 else sums[start, end] == best


def test_pages_give_the_run_with_the_largest_sum():
    w = html.weights()
    for page, _ in layouts.pages()[::7]:
        found = [b for b in html.blocks(page, w) if b.score > 0]
        v = html.values(found, w)
        best = max((sum(v[i:j]), -i, j) for i in range(len(v)) for j in range(i + 1, len(v) + 1)) if v else None
        text = html.main_text(page)
        assert text == "\n\n".join(b.text for b in found[-best[1] : best[2]]) if best and best[0] > 1e-9 else text == ""


def test_deep_nesting_takes_linear_memory():
    import tracemalloc

    peaks = []
    for n in (2_000, 8_000):
        page = "".join(f"<div class='own{i} x{i}'>" for i in range(n)) + "text here"
        tracemalloc.start()
        assert html.main_text(page) == "text here"
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0] < 100_000_000


@pytest.mark.parametrize("part", ["<a<a ", "<!", '<p x="', "<title>", "<p>x", "</div>", "<ul><li>x", "&", "<script "])
def test_broken_pages_take_no_longer_than_their_length(part):
    import time

    began = time.perf_counter()
    html.main_text(part * 60_000)
    assert time.perf_counter() - began < 20


def test_columns(spark):
    rows = [(1, "u", CASES["article"][0]), (2, None, None), (None, "u", ""), (4, "u", "<p>" + LONG + "</p>"), (4, "u", "<p>" + LONG + "</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = html.extract(clashing(pages)).collect()
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got]
    assert sorted(r["n_chars"] for r in got) == [0, 0, len(CASES["article"][1]), len(LONG), len(LONG)]
    assert html.extract(pages.limit(0)).count() == 0
