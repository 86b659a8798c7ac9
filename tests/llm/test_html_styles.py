"""The main text of pages as sites write them that no training page was like, told by hand."""

import pytest

from ripplegraph.llm import html_text

ONE = "A sentence of some length, as articles have them, with several words and a comma or two. It goes on for a while."
TWO = "Another one follows it, which is about as long as the first, and has something else to say."
NAV = "<nav><ul><li><a href=x>home</a></li><li><a href=y>news</a></li></ul></nav>"
END = "<footer>imprint</footer></body></html>"
PAGES = {
    "list": (f"<html><body>{NAV}<article><h1>Title of it</h1><p>{ONE}</p><ul><li>first point of the plan</li><li>second point</li></ul><p>{TWO}</p></article>{END}", ["Title of it", ONE, "first point of the plan", "second point", TWO]),
    "table": (f"<html><body>{NAV}<article><h1>Title</h1><p>{ONE}</p><table><tr><td>height</td><td>120 m</td></tr></table><p>{TWO}</p></article>{END}", ["Title", ONE, "height", "120 m", TWO]),
    "link": (f"<html><body>{NAV}<article><h1>Title</h1><p>{ONE}</p><p><a href=z>the whole report of the year</a></p><p>{TWO}</p></article>{END}", ["Title", ONE, "the whole report of the year", TWO]),
    "header": (f"<html><body>{NAV}<article><header><h1>Title of the story</h1></header><p>{ONE}</p><p>{TWO}</p></article>{END}", ["Title of the story", ONE, TWO]),
    "comments": (f"<html><body><div class=menu><a href=x>home</a></div><div class=content><h1>Title</h1><p>{ONE}</p><p>{TWO}</p></div><div class=disqus><p>I think this is wrong.</p><p>me too</p></div><div class=footer>imprint</div></body></html>", ["Title", ONE, TWO]),
    "divisions": (f"<html><body><div class=nav><a href=x>home</a></div><div><h1>Title</h1><p>{ONE}</p><p>{TWO}</p><blockquote><p>{ONE}</p></blockquote></div><div class=sidebar><p>{TWO}</p></div></body></html>", ["Title", ONE, TWO, ONE]),
    "form": (f"<html><body>{NAV}<main><h1>Title</h1><p>{ONE}</p><form><p>Your mail</p></form><p>{TWO}</p></main><div class='cookie notice'>We use cookies.</div></body></html>", ["Title", ONE, TWO]),
}


@pytest.fixture(scope="module")
def found(spark):
    model = html_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    rows = [(i, k, html) for i, (k, (html, _)) in enumerate(PAGES.items())]
    return model, {r["url"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), model).collect()}


@pytest.mark.parametrize("style", sorted(PAGES))
def test_styles(found, style):
    assert found[1][style].split("\n") == PAGES[style][1]


def test_all_given_pages(spark, found):
    """The generator's articles, page by page, of ten times the pages that were trained on."""
    pages = [html_text.blocks(r["html"]) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]
    wrong = sum(any(bool(k) != bool(html_text.weak_label(b.path)) for b, k in zip(p, g, strict=True)) for p, g in zip(pages, html_text.label(found[0], pages), strict=True))
    assert wrong <= len(pages) // 1000
