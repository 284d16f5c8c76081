import html
import re

import pytest
from pyspark.sql import functions as F

from statloom.llm.html_extract import extract, main_blocks, parse, train
from statloom.llm.text import table


@pytest.fixture(scope="module")
def extractor(spark, small):
    return train(table(spark, small, "pages"))


def article(page):
    body = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S)[1]
    body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", body))
    return re.sub(r"\s+", " ", html.unescape(body)).strip()


def test_articles_of_all_pages(spark, extractor):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = extract(pages, extractor, kept=("page_id", "html")).collect()
    assert len(rows) == pages.count()
    assert all(r.text == article(r.html) and r.n_chars == len(r.text) for r in rows)


def test_other_markup(extractor):
    page = """<html><body><div class='menu'><a href=x>Home</a><a>About</a></div><div class='post'><h1>Title  here</h1>
    <p>First <b>para</b>graph of text with many words in it, &amp; indeed more.<p>Second paragraph, it goes on and on.</div>
    <div class='comments'><p>I liked this a lot, thank you for the article.</p></div><div id='sidebar'><p>Other</p></div>
    <form><p>Sign up</p></form><script>var x='<p>no</p>'</script><footer>c 2020</footer></body></html>"""
    assert main_blocks([page], extractor)[0] == [
        "Title here", "First paragraph of text with many words in it, & indeed more.", "Second paragraph, it goes on and on.",
    ]
    inner = "<article><p>Body text and some more words.</p><aside>Related</aside><section class='comments'><p>nice</p></section></article>"
    assert main_blocks([inner], extractor)[0] == ["Body text and some more words."]


def test_children_never_outlive_parents(extractor):
    for page in ("", "text", "<p>Just text", "<b><p>a</b>", "<div>" * 3_000 + "deep", "</p></div>", "<!-- c --><![CDATA[x]]>", "<a", "&#0;&bogus;&amp"):
        nodes = parse(page)
        assert all(n.parent < i for i, n in enumerate(nodes))
        assert isinstance(main_blocks([page], extractor)[0], list)


def test_odd_rows(spark, extractor):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>same</p>", "x"), (None, "u", "<p>same</p>", "x"), (3, "u", "<article><p>" + "long text " * 60_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(pages, extractor).collect()}
    assert got[1, "u"] == ("", 0) and got[2, None] == ("", 0) and got[3, "u"][1] == 60_000 * 10 - 1
    assert extract(pages.limit(0), extractor).count() == 0
    assert train(pages.where(F.lit(False))).forest.values
