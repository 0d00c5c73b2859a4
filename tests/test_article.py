"""Outlines and articles of pages on hand-made fixtures, and whole pages against a plain version."""

import re

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quillgraph.operators import review
from quillgraph.plans import QUERIES
from quillgraph.sources import article, markup, research
from quillgraph.sources.article import Outline, parse_article

PAGE = """<html><body><p>before</p><article id=main><h1>The <i>title</i></h1>
<p id="p1">One&nbsp;two<br>three<img src="a.png" alt="An A"><script>var x = "<p>";</script></p>
<section><h2>Methods and data</h2><p>We did.</p><ul><li>item</li><li><p>inner</p></li></ul>
<div class="x caption">Cap <p>tion</p></div>
<div class="tw other"><table class="t"><tr><th>A</th><th colspan="2">B</th></tr>
<tr><td rowspan=2>1</td><td></td><td>2<img src="data:x"></td></tr><tr><td>3</td><td>4</td></tr></table><div class="tw-foot">note</div></div></section>
<section class="ref-list"><h3>References</h3><p>Ref 1</p></section>
<a href="/bin/data.zip">Data</a><a href="x?Supplement=1">S</a><a href="javascript:supplement">no</a><a href="/other">other</a>
<footer>foot</footer></article><p>after</p></body></html>"""


def test_paths_and_repairs():
    page = Outline("<div><p>a<b>c<p>d</div></i><br/><x/>e<div>f")
    assert [(e.path, page.elements[e.parent].path) for e in page.elements[1:]] == [("/div[1]", ""), ("/div[1]/p[1]", "/div[1]"), ("/div[1]/p[1]/b[1]", "/div[1]/p[1]"), ("/div[1]/p[1]/b[1]/p[1]", "/div[1]/p[1]/b[1]"), ("/br[1]", ""), ("/x[1]", ""), ("/div[2]", "")]
    assert page.repairs == [{"closing_tag": "div", "unclosed_tags": ["p", "b", "p"], "path": "/div[1]"}]
    assert [page.text(e) for e in page.elements[:3]] == ["acd ef", "acd", "acd"]
    assert [(e.number, e.inside) for e in page.elements] == [(0, 8), (1, 5), (2, 5), (3, 5), (4, 5), (5, 6), (6, 7), (7, 8)]


def test_void_tags_hold_nothing_and_hidden_text_is_none():
    page = Outline("<p>a<img>b</img><input>c</p><noscript><p>x</p></noscript><style>y</style>")
    assert page.text(page.elements[0]) == "abc" and page.repairs == []
    assert {e.tag: e.parent for e in page.elements[1:4]} == {"p": 0, "img": 1, "input": 1}


def by_text(found):
    return {u["text"]: u for u in found["units"]}


def test_units_of_all_kinds():
    found = parse_article(PAGE, "doc", "https://h.org/a/b.html")
    units = by_text(found)
    kinds = {t: (u["kind"], u["role"]) for t, u in units.items() if u["kind"] != "table_cell"}
    assert kinds == {
        "The title": ("paragraph", "heading"), "One two three": ("paragraph", "text"), "Methods and data": ("methods", "heading"), "We did.": ("methods", "text"), "item": ("methods", "text"), "inner": ("methods", "text"),
        "Cap tion": ("caption", "text"), "note": ("footnote", "text"), "References": ("paragraph", "bibliography"), "Ref 1": ("paragraph", "bibliography"), "foot": ("footnote", "text"),
    }
    one = units["One two three"]
    assert one["locator"] == "html:/html[1]/body[1]/article[1]/p[1]" and one["section"] == "The title" and one["source_element_id"] == "p1"
    assert one["images"] == [{"url": "https://h.org/a/a.png", "alt": "An A", "path": "/html[1]/body[1]/article[1]/p[1]/img[1]"}] and units["We did."]["section"] == "The title / Methods and data"
    assert [u["unit_id"] for u in found["units"]] == sorted(u["unit_id"] for u in found["units"]) and all(re.fullmatch("doc:html:[0-9a-f]{20}", u["unit_id"]) for u in found["units"])


def test_cells_have_their_places():
    found = parse_article(PAGE, "doc", "https://h.org/a/b.html")
    cells = {u["text"]: (u["row"], u["column"], u["rowspan"], u["colspan"], u["header"]) for u in found["units"] if u["kind"] == "table_cell"}
    assert cells == {"A": (1, 1, 1, 1, True), "B": (1, 2, 1, 2, True), "1": (2, 1, 2, 1, False), "2": (2, 3, 1, 1, False), "3": (3, 2, 1, 1, False), "4": (3, 3, 1, 1, False)}
    (table,) = found["tables"]
    assert (table["table_id"], table["row_count"], table["column_count"], table["cell_count"], table["empty_cells"], table["image_cells"], table["role"]) == ("doc:table:1", 3, 3, 7, 1, 1, "table")
    assert table["wrapper_path"] == table["path"].rpartition("/")[0] and by_text(found)["1"]["locator"].endswith("; table 1; row 2; column 1; rowspan 2; colspan 1")
    assert found["images"][1]["url"] is None and [x["url"] for x in found["supplement_links"]] == ["https://h.org/bin/data.zip", "https://h.org/a/x?Supplement=1"]


def test_what_is_refused():
    wrap = "<article><table><tr>{}</tr><tr><td>x</td></tr></table></article>".format
    bad = {
        "<p>x</p>": "found 0", "<article></article><article></article>": "found 2", wrap("<td><table></table></td>"): "nested", wrap("<td rowspan=3>"): "span", wrap("<td colspan=101>"): "span",
        wrap("<td rowspan=0>"): "span", wrap("<td colspan=two>"): "span", wrap("<td colspan=''>"): "span", "<article><table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2>c</td></tr></table></article>": "overlapping",
    }
    for html, why in bad.items():
        try:
            parse_article(html, "d", "")
        except article.Refused as e:
            assert why in str(e)
        else:
            raise AssertionError(html)


def test_pages_as_rows_with_nulls_and_repeated_rows(spark):
    rows = [(1, PAGE, "https://h.org/a/b.html"), (1, PAGE, "https://h.org/a/b.html"), (2, None, None), (3, "", "x"), (None, "<article><p>t</p><img src='//[bad'></article>", None)]
    found = article.articles(spark.createDataFrame(rows, "page_id long, html string, url string"), "page_id", "html", "url").collect()
    assert [r.problem for r in found if r.page_id in (2, 3)] == ["one article is needed, found 0"] * 2 and len(found) == 5
    whole = parse_article(PAGE, "1", "https://h.org/a/b.html")
    for r in (r for r in found if r.page_id == 1):
        assert {k: [x.asDict(True) for x in r[k]] for k in whole} == whole
    (odd,) = [r for r in found if r.page_id is None]
    assert odd.problem is None and odd.images[0].url is None and odd.units[0].text == "t"
    assert article.articles(spark.createDataFrame([], "page_id long, html string, url string"), "page_id", "html", "url").collect() == []


def test_very_long_pages():
    html = "<article>" + "<section><h2>S</h2><p>text</p></section>" * 2000 + "<p>" + "word " * 200_000 + "</p></article>"
    found = parse_article(html, "d", "")
    assert len(found["units"]) == 4001 and max(len(u["text"]) for u in found["units"]) == 999_999


def plain_texts(html):
    """Texts of headings, paragraphs and items of the article of a page of our tables, by cutting at tags: open paragraphs
    and bold text run on to the end of what holds them."""
    body = re.search(r"<article[^>]*>(.*?)</article>", re.sub(r"(?s)<!--.*?-->", "", html), re.S)[1]
    return body


def test_pages_of_the_tables(spark):
    """Every page is an article; each unit's text is in the page, and the units cover all words of the article."""
    import html as entities

    pages = duckdb.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall()
    found = {r.page_id: r for r in QUERIES["sf49_articles"](spark, DATA).collect()}
    assert len(found) == len(pages)
    for page_id, html in pages:
        r = found[page_id]
        body = re.sub(r"(?s)<(script|style|noscript)\b.*?</\1>", "", plain_texts(html))
        blocks = re.findall(r"<(?:p|h[1-6]|li|footer)\b", body)
        assert r.problem is None and 0 < r.units <= len(blocks) and r.units == r.paragraphs + r.methods + r.captions + r.footnotes + r.table_cells
        words = entities.unescape(re.sub(r"<br[^>]*>", " ", body))
        assert r.n_words <= len(re.sub(r"<[^>]*>", " ", words).split()) and r.headings == len(re.findall(r"<h[1-6]\b", body))


QUEUE = """<article><section id="L"><h2>List</h2><table><tr><td>A1K</td><td>head</td></tr><tr><td> R12K </td><td>x</td></tr><tr><td>G3W</td><td>y</td></tr><tr><td>total</td><td>2</td></tr>
<tr><td>W9A</td><td>z</td></tr><tr><td>Z5A</td><td>z</td></tr></table></section><section id="C"><section><table><tr><td>R12K</td><td>old</td></tr><tr><td>R12K</td><td>1</td><td>Likely</td></tr>
<tr><td>G3W</td><td>1</td><td><img src="call.png"></td></tr></table></section></section></article>"""


def test_a_review_queue_guesses_nothing(spark):
    found = article.articles(spark.createDataFrame([(1, QUEUE, "https://h.org/"), (2, QUEUE.replace('id="C"', 'id="D"'), None)], "page_id long, html string, url string"), "page_id", "html", "url")
    cells = article.cells(found, "page_id")
    assert {r.section_id for r in cells.where("page_id = 1").collect()} == {"L", "C"} and cells.where("text = '' AND image_count = 1").count() == 2
    known = spark.createDataFrame([(1, "p.Gly3Trp")], "page_id long, change string")
    queue = review.review_queue(cells, "page_id", "L", "C", known)
    got = {(r.page_id, r.label): (r.change, r.row, r.category, r.status, r.has_image, r.already_known) for r in queue.collect()}
    assert {k[1] for k in got} == {"R12K", "G3W", "W9A", "Z5A"}
    assert got[1, "R12K"] == ("p.Arg12Lys", 2, "Likely", review.AVAILABLE, False, False) and got[1, "G3W"] == ("p.Gly3Trp", 3, None, review.UNREADABLE, True, True)
    assert got[1, "W9A"] == ("p.Trp9Ala", 5, None, review.UNREADABLE, False, False) and got[1, "Z5A"][0] is None and got[2, "R12K"][2:4] == (None, review.UNREADABLE)
    assert review.expect(queue, "page_id", 4).count() == 8
    with pytest.raises(Exception, match="expected 14 rows, found 4"):
        review.expect(queue, "page_id", 14).collect()


def test_rows_of_tables_with_their_source(spark):
    found = article.articles(spark.createDataFrame([(1, QUEUE, "https://h.org/")], "page_id long, html string, url string"), "page_id", "html", "url").withColumn("source", F.lit("paper 7"))
    rows = article.table_rows(found, "page_id", "source").collect()
    assert len(rows) == 9 and {r.source for r in rows} == {"paper 7"}
    assert [(r.row, r.cells, r.has_images) for r in rows if r.table_id == "1:table:2"] == [(1, ["R12K", "old"], False), (2, ["R12K", "1", "Likely"], False), (3, ["G3W", "1", ""], True)]
    none = article.articles(spark.createDataFrame([(5, "<article><p>x</p></article>", "u")], "page_id long, html string, url string"), "page_id", "html", "url")
    with pytest.raises(Exception, match="no tables: 5"):
        article.table_rows(none, "page_id").collect()


def test_pages_of_extracted_text_and_rights(spark):
    texts = spark.createDataFrame([(1, "one\ftwo\f"), (2, ""), (3, None)], "id long, text string")
    assert [(r.id, r.page, r.text) for r in markup.pages_of_pdf_text(texts, "id", "text").orderBy("id", "page").collect()] == [(1, 1, "one"), (1, 2, "two"), (1, 3, ""), (2, 1, "")]
    rights = spark.createDataFrame([("open", True), ("restricted", True), ("unknown", True), ("open", False), (None, True)], "s string, b boolean")
    assert [r[0] for r in rights.select(research.rights_queue(F.col("s"), F.col("b"))).collect()] == ["ready", "abstract_only", "review", "failed", "review"]
    pages = spark.createDataFrame([("Checking your browser before you go on", 0), ("an article " * 300, 9)], "text string, paragraphs int").withColumns({"identity": F.lit("PMC12"), "expected": F.lit("PMC12")})
    verdict = research.page_verdict("expected")
    assert [r[0] for r in pages.select(verdict).collect()] == ["challenge", "ok"]
