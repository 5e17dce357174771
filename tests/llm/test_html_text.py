import html
import random
import re

import numpy as np
import pytest

from strandlake.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<article><h1>A &amp; B</h1><p>One  two\n three<br>four</p><p>&#233;&eacute;&nbsp;x</p></article>", "A & B\nOne two three four\néé x"),
        ("<article><p>Stays in.</p><script>var x='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>Also in.</p>", "Stays in.\nAlso in."),
        ("<nav><a href='/'>Home</a></nav><article><p>Body text of some length that is read.</p></article><footer>Foot words here</footer>", "Body text of some length that is read."),
        ("<article><p>Main words.</p><div class='comments'><p>A reader writes at some length about this article and its faults.</p></div></article>", "Main words."),
        ("<article><p>Main words.</p><form><p>Subscribe to our letter today and never miss one.</p></form><p>More words.</p></article>", "Main words.\nMore words."),
        ("<article><p>Unclosed <b>bold<p>Next one", "Unclosed bold\nNext one"),
        ('<article><p title="a > b">Quoted sign.</p></article>', "Quoted sign."),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<article><p>Use <svg/> icons</p><p>tail one</p><svg></svg><p>tail two</p></article>", "Use icons\ntail one\ntail two"),
        ('<p>One two three.</p><svg class="i"/><p>More words follow here.</p>', "One two three.\nMore words follow here."),
        ('<div class="entry"><p>Read <a>the long linked title of another story</a> here.</p></div>', "Read the long linked title of another story here."),
        (f'<div class="related-work"><p>{"word " * 40}</p></div><div class="related-posts"><p>{"other " * 40}</p></div>', "word " * 39 + "word"),
        ('<article><p>Main words.</p></article><article class="comment-body"><p>I read it all, and liked it.</p></article>', "Main words."),
        ('<div>Some notice outside of it all</div><main><p>In it.</p></main>', "In it."),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_labelled_layouts_are_learned():
    for layout in html_text.LAYOUTS:
        found = html_text.blocks(html_text.labelled(layout))
        assert [b.text[0] == "+" for b in found] == html_text.classified(html_text.features(found)).tolist()


def used(node):
    return set() if node.feature < 0 else {html_text.FEATURES[node.feature]} | used(node.low) | used(node.high)


def test_counts_and_densities_of_neighbours_decide():
    assert {"words", "link_density"} <= used(html_text.tree()) and used(html_text.tree()) & {"words_before", "link_density_before", "words_after", "link_density_after"}
    links = "<div><a href=/a>one</a></div><div><a href=/b>two three</a></div>"
    text = "<div>" + "word " * 30 + "</div>"
    assert html_text.main_text(f"<div>A title</div>{links}{text}") == ("word " * 30).strip()
    assert html_text.main_text(f"{links}{text}<div>A title</div>{text}").split("\n")[1] == "A title"


def every_cut(x, y):
    """The least weighted Gini impurity of any cut, by trying all."""
    impurity = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v) if len(v) else 0.0
    return min((impurity(y[x[:, f] <= c]) + impurity(y[x[:, f] > c]) for f in range(x.shape[1]) for c in np.unique(x[:, f])[:-1]), default=np.inf)


def test_tree_takes_the_best_cut_and_breaks_ties_by_order():
    r = np.random.default_rng(0)
    for _ in range(20):
        x, y = r.integers(0, 4, (30, 5)).astype(float), r.integers(0, 2, 30).astype(float)
        node = html_text.grown(x, y, 1)
        low = x[:, node.feature] <= node.cut
        assert np.isclose(sum(2 * v.mean() * (1 - v.mean()) * len(v) for v in (y[low], y[~low])), every_cut(x, y))
    x = np.repeat(r.integers(0, 4, (30, 1)).astype(float), 3, axis=1)
    assert html_text.grown(x, (x[:, 0] > 1).astype(float)).feature == 0


def plain_blocks(page):
    """A second reading of flat blocks: text between block tags, for pages without raw elements."""
    parts = re.split(r"(<[^>]*>)", page)
    out, now = [], ""
    for p in parts:
        m = re.match(r"</?([a-z0-9]+)", p) if p.startswith("<") else None
        if m and m[1] in html_text.BREAKS:
            out.append(now)
            now = ""
        elif m:
            now += " " if m[1] == "br" else ""
        else:
            now += p
    return [" ".join(html.unescape(t).split()) for t in [*out, now] if html.unescape(t).split()]


def test_blocks_against_a_plain_reading():
    r = random.Random(3)
    tags = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<br>", "<a href=/x>", "</a>", "<li>", "<ul>", "</ul>", "<h2>", "</h2>", "<i>", "</i>", "<td>", "<article>", "</article>"]
    words = ["one", " two ", "&amp;", "x&nbsp;y", "\n", "a\t\tb", "&#233;", "", "end."]
    for _ in range(300):
        page = "".join(r.choice(tags) if r.random() < 0.5 else r.choice(words) for _ in range(r.randint(0, 40)))
        assert [b.text for b in html_text.blocks(page)] == plain_blocks(page), page


def test_extract(spark):
    rows = [(1, "u", "<article><p>x y</p></article>"), (None, None, None), (1, "u", "<article><p>x y</p></article>"), (2, "v", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'clash' as text", "1 as n_chars")
    got = html_text.digest(html_text.extract(pages)).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 3), (None, 0), (1, 3), (2, 499_999)]
    assert html_text.extract(pages.limit(0)).count() == 0


WORDS = "word " * 40


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><a>Home</a> <a>About us</a> <a>Contact</a> <a>News</a></div><p>{WORDS}</p>", WORDS.strip()),
        (f"<p>{WORDS}</p><a href=x><div>Another long story title</div></a><a href=y><div><h3>One more</h3><p>of several words</p></div></a>", WORDS.strip()),
        (f"<div class=entry><p>{WORDS}</p></div><article class=card><p>teaser</p></article>", None),
        (f"<article><h1>On shops</h1><p>{WORDS}</p><section class='advertising-history'><p>{WORDS}</p></section><div class='subscription-model'>{WORDS}</div></article>", f"On shops\n{WORDS.strip()}\n{WORDS.strip()}\n{WORDS.strip()}"),
        (f"<article><p>{WORDS}</p><div class=advert-box>{WORDS}</div></article>", WORDS.strip()),
        (f"<article><p>{WORDS}</p><object data=x><p>more {WORDS}</p></article>", f"{WORDS.strip()}\nmore {WORDS.strip()}"),
        (f"<article><p>{WORDS}<label>all of it</label></p></article>", f"{WORDS.strip()}\nall of it"),
        (f"<article><p>AT&<b>amp</b>;T &lt;b&gt; {WORDS}</p></article>", f"AT&amp;T <b> {WORDS.strip()}"),
        (f"<article><p>{WORDS}<a href=x>unclosed<p>{WORDS}</article>", f"{WORDS.strip()} unclosed\n{WORDS.strip()}"),
        (f"<main><p>{WORDS}</p></main><div>{WORDS * 9}</div>", WORDS.strip()),
    ],
)
def test_pages_that_mislead(page, text):
    got = html_text.main_text(page)
    assert got == text if text is not None else WORDS.strip() in got.split("\n")


def test_linked_words_are_those_of_the_text_in_links():
    linked = lambda page: [(b.words, b.linked) for b in html_text.blocks(page)]
    assert linked("<p><a>one two</a> <a>three</a>four <a>fi<b>ve</b></a></p>") == [(4, 4)]
    assert linked("<p>a <a>b c</a> d <a>e</a> f</p>") == [(6, 3)]
    assert linked("<p>a <a>b c<p>d e") == [(3, 2), (2, 0)]
    assert linked("<div><a>b<div>c d</a> e</div>f</div>") == [(1, 1), (3, 0), (1, 0)]
    assert linked("<a><div>c d</div><div>e</div></a><div>f</div>") == [(2, 2), (1, 1), (1, 0)]


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x" + "</section></p></i>" * 60_000, "<svg>" * 30_000 + "x", "<p>" * 100_000 + "</div>" * 100_000, "<a>x<div>" * 30_000])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 20


def test_features_and_tree_by_brute_force():
    """Each block's numbers from the list of blocks alone, and the tree walked row by row."""
    pages = [html_text.labelled(x) for x in html_text.LAYOUTS]
    for page in pages:
        found = html_text.blocks(page)
        x = html_text.features(found)
        for k, b in enumerate(found):
            own = lambda i: (found[i].words, found[i].linked / found[i].words) if 0 <= i < len(found) else (0, 0)  # noqa: B023, E731
            assert x[k, :6].tolist() == [*own(k), *own(k - 1), *own(k + 1)]
            node = html_text.tree()
            while node.feature >= 0:
                node = node.low if x[k, node.feature] <= node.cut else node.high
            assert node.main == html_text.classified(x)[k] == (b.text[0] == "+")
