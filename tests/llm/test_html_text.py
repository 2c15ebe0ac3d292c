import html
import re

import pytest

from cladeflow.llm import html_text
from cladeflow.llm.common import table
from cladeflow.llm.queries import op1_html_text

TREE = html_text.trained()
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain words, no tags at all here and long enough to be a text", "plain words, no tags at all here and long enough to be a text"),
    ("<article>a<b>b</b>c &amp; &eacute;&#x41;&nbsp; d<br>e<p>f</article>", "abc & éA d e f"),
    ("<nav><a>x</a></nav><article><h1>T</h1><p>Er.<script>var a='</p>';</script> ok<!-- no --> go</article><footer>f</footer>", "T Er. ok go"),
    ("<article><p>one<p>two <style>p{}</style><form>mail <input></form><aside>no</aside><p>three", "one two three"),
    ("<main><p>a < b and c > d</p></main>", "a < b and c > d"),
    ('<article><p title="a > b">kept</p><div class="comments"><p>no no</p></div></article>', "kept"),
    ("<article><header><h1>Title</h1><p>By us</header><p>Text", "Title Text"),
    ("<article><p>cut<!-- never closed <p>gone", "cut"), ("<article>x<script>never closed", "x"),
    ('<article><p>a</p><div role="navigation"><p>menu</div><p hidden>h</p><p>b</article>', "a b"),
])
def test_pages(page, want):
    assert html_text.main_text(page, TREE) == want


def test_tree_agrees_with_its_labelled_table():
    for page, marks in html_text.LABELLED:
        got = [html_text.share(TREE, row) >= 0.5 for row in html_text.describe(html_text.blocks(page))]
        assert got == [m == "1" for m in marks]


def test_whole_table_matches_what_the_articles_hold(spark):
    def plain(page):
        body = re.sub(r"</?(p|h1|br)>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        return " ".join(html.unescape(re.sub("</?b>", "", body)).split())

    want = {r.page_id: plain(r.html) for r in table(spark, DATA, "pages").collect()}
    got = op1_html_text(spark, DATA).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_nulls_repeats_long_pages_and_no_pages(spark):
    long = "<article>" + "<p>é &lt;" * 50_000 + "<div " * 20_000
    rows = [(1, None, None, "t"), (1, None, None, "t"), (2, "u", long, "t"), (None, "u", "<a>x</a>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id == 1] == ["", ""]
    assert next(r.text for r in got if r.page_id == 2).startswith("é < é <")
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page,want", [
    ('<article><p>A <span class="ad">x</span> B</p><p>C</p></article>', "A B C"),
    ('<article><p>A<i class="share-icon"></i>B <small class="tags">t <small>u</small> v</small> C<p>D</article>', "AB C D"),
    ('<article><p>A <span hidden>x <b>y</b><div>z</div></span>B</p><p>C</article>', "A B C"),
    ('<article><p>A <span hidden>x</p><p>B</p></article>', "A B"), ('<article><div>A <b class="ad">x</div><p>B</article>', "A B"),
    ('<article><p>A <img class="ad">B</b></span> C</p></article>', "A B C"),
])
def test_inline_furniture_ends_with_its_element(page, want):
    assert html_text.main_text(page, TREE) == want


@pytest.mark.parametrize("page,want", [
    ('<div class="layout has-sidebar"><article><h1>T</h1><p>Text.</p></article><div class="sidebar"><p>Side</p></div></div>', "T Text."),
    ('<div class="with-header no-sidebar"><main><p>Text of it.</p></main></div>', "Text of it."),
    ('<article class="post tag-social category-legal"><p>Text.</p></article>', "Text."),
    ('<div class="post tag-social"><p>Text.</p><div class="category-menu"><a>Menu</a></div></div>', "Text."),
    ('<article class="entry comments-open"><p>Text.</p></article>', "Text."),
    ('<article><div class="post-header"><h1>Title</h1><p>By us</p></div><p>Text</p></article>', "Title Text"),
    ('<article><p>A <a class="share" href="x">Share</a> B <a aria-hidden="true">#</a> C <a href="y">kept</a></p></article>', "A B C kept"),
    ('<article><p>Text</p><section id="comments"><article class="comment"><p>Reader</p></article></section></article>', "Text"),
    ('<article><p>Text</p></article><article class="related"><p>Read this too</p></article><div class="site-sidebar"><p>Side</p></div>', "Text"),
])
def test_class_names_of_layouts_are_no_furniture(page, want):
    assert html_text.main_text(page, TREE) == want
