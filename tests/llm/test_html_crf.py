import time

import pytest

from curbline.llm.html_crf import default_field, extract_pages, labelled_pages, leaf_blocks

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Logo</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site.</p></div><!-- ad <p>no</p> -->
<article><h1>A &amp; B</h1><p>First  paragraph\n of the <b>story</b>, which goes on for some words&#33;<p>Second &lt;one&gt; is here, and it is quite long too.</p>
<div class="ad">Buy this now</div><ul><li>Item one of the list<li>Item two of it.</ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="#">Other story</a></ul></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Nice story, I liked it a lot.</p></div></section>
<form action="/s"><label>Search</label><button>Go</button></form><footer>&copy; 2024 Site</footer>"""
MAIN = ["A & B", "First paragraph of the story, which goes on for some words!", "Second <one> is here, and it is quite long too.", "Item one of the list", "Item two of it."]


def test_main_text():
    assert default_field().extract(PAGE) == MAIN


def test_held_out_pages():
    field, pages = default_field(), labelled_pages(150, seed=99)
    same = [a == bool(b) for blocks, labels in pages for a, b in zip(field.decode(blocks), labels)]
    assert sum(same) / len(same) > 0.98


@pytest.mark.parametrize("html,texts", [
    (None, []), ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<br>b&nbsp; c</p>", ["a b c"]), ("<b>x<p>y</b>z", ["x", "yz"]),
    ("<script>never closed <p>x", []), ("a<!-- b", ["a"]), ("<p title='a>b'>q</p>", ["q"]), ("1 < 2 <p>&amp;lt;</p>", ["1 < 2", "&lt;"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
])
def test_blocks(html, texts):
    assert [b.text for b in leaf_blocks(html)] == texts


@pytest.mark.parametrize("html,texts", [
    ('<p>one</p><svg class="i"/><p>two two</p>', ["one", "two two"]), ("<p>one</p><svg><p>two</p>", ["one", "two"]), ("<p>a</p><svg/><p>b</p><svg><g/></svg><p>c</p>", ["a", "b", "c"]),
    ("<svg><p>a</p><svg>x</svg><p>b</p>", ["a", "b"]), ("<svg>x<svg>y</svg>z</svg>q", ["q"]), ("<svg>x<!-- </svg> -->y</svg>q", ["q"]), ("<template/>a<noscript>b", ["ab"]), ('<svg title="a>b"/>q', ["q"]),
    ("<noscript><p>x</p></noscript><p>y</p>", ["y"]), ("<SVG>x</Svg>y", ["y"]), ("<title-bar>a</title-bar>b", ["ab"]), ("<svg-icon>a</svg-icon>b", ["ab"]), ("<style>x", []),
])
def test_hidden_elements_end(html, texts):
    assert [b.text for b in leaf_blocks(html)] == texts


def test_table(spark):
    rows = [(1, "u", PAGE, 3), (2, None, None, 1), (None, "v", "", 1), (4, "w", "<nav><a>x</a></nav>", 0), (1, "u", PAGE, 3), (5, "é", f"<article><p>{'é word. ' * 30_000}</p></article>", 0)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    by = {(r.page_id, r.url): r for r in got}
    assert len(got) == 6 and by[1, "u"].text == "\n".join(MAIN) and by[1, "u"].n_chars == len("\n".join(MAIN))
    assert by[2, None].text == by[None, "v"].text == by[4, "w"].text == "" and by[4, "w"].n_chars == 0
    assert by[5, "é"].n_chars == len(("é word. " * 30_000).strip())
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_labelled_by_hand():
    """Block F1 on pages that the generator did not make."""
    from tests.llm.pages_by_hand import PAGES

    field, hits, found, wanted = default_field(), 0, 0, 0
    for page in PAGES:
        truth = [b.text.startswith("+") for b in leaf_blocks(page)]
        got = field.decode(leaf_blocks(page.replace(">+", ">")))
        assert len(got) == len(truth) and any(truth)
        hits, found, wanted = hits + sum(a and b for a, b in zip(got, truth)), found + sum(got), wanted + sum(truth)
    assert len(PAGES) >= 20 and 2 * hits / (found + wanted) >= 0.9
    print("block F1", 2 * hits / (found + wanted), "precision", hits / found, "recall", hits / wanted)


def test_viterbi_against_all_labellings(spark):
    """The query's text is that of the best of all labellings, on pages short enough to try them all."""
    from itertools import product

    from curbline.llm.html_crf import features
    from tests.llm.pages_by_hand import PAGES

    field = default_field()
    pages = [p.replace(">+", ">") for p in PAGES if len(leaf_blocks(p)) <= 11][:8]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert len(pages) >= 5
    for i, page in enumerate(pages):
        blocks = leaf_blocks(page)
        own = [sum(field.weights.get(f, 0.0) for g in features(b) for f in g) for b in blocks]
        score = lambda labels: sum(s for s, x in zip(own, labels) if x) + sum(field.move[a][b] for a, b in zip(labels, labels[1:]))
        best = max(product((0, 1), repeat=len(blocks)), key=score)
        assert got[i] == "\n".join(b.text for b, x in zip(blocks, best) if x)


def test_broken_pages_in_linear_time():
    """Tags that never end, quotes that never close, and a quote before the last >: each of some 5 MB."""
    began = time.process_time()
    for shape, n in (("<div ", 1_000_000), ("<svg '\"", 700_000), ("<a x='", 830_000), ("<a", 2_500_000), ("<script ", 600_000), ("<svg", 1_200_000)):
        for tail in ("", ">", "'>", " '>", "\" '>text"):
            leaf_blocks(shape * (n // 10) + tail)
        leaf_blocks(shape * n + "\" '>text")
        leaf_blocks(shape * n)
    assert time.process_time() - began < 90


def test_markup_that_is_broken_is_text():
    texts = lambda html: [b.text for b in leaf_blocks(html)]
    assert texts("<p>one <b two") == ["one <b two"]
    assert texts("<p>a<br>b<div title='x>y'>c</div><!-- <p>no</p> --><p title=\"open>d</p>") == ["a b", "c", '<p title="open>d']
    assert texts("<p>x</p><svg a='><path>'>hidden</svg><p>y</p><svg class=\"i\"/><p>z</p>") == ["x", "y", "z"]
    assert texts("<p>1 < 2</p><script>if (a<b) '</p>'</script><style>p{}") == ["1 < 2"]
    assert texts("<p>t</p><textarea>raw <p></textarea ><p>u") == ["t", "u"] and texts("<p>t</p><template><p>in</p></template>v") == ["t", "v"]
    assert texts("<?xml x?><!doctype html><p>w</p></ p><1>") == ["w", "</ p><1>"]
