from datetime import date

from claimloom.operators import articles as A
from claimloom.operators.dom import tree

FULL = """<html><head><title>Ice is growing</title><meta name="keywords" content="ice, <b>snow</b>, sea"><meta name="description" content="About ice"></head><body>
<div id="centerColumn"><p><a title="View this argument in German" href="/translation.php?a=1&amp;l=6">de</a><a title="other" href="x">x</a></p></div>
<div id="mainbody"><table><tr><td>Select a level...</td><td><a href="/ice-int.htm">Intermediate</a></td><td>Basic</td></tr></table>
<h2>What the science says</h2><div>It is <i>melting</i>.</div>
<div class="comment myth">Ice grows <a href="http://s.example/1">Source One</a></div>
<div><h2>At a glance</h2><p>First.</p><p>Second.</p><div class="bluebox">stop</div></div>
<div><div><a id="FurtherDetails"></a></div></div>
<div><p>unused</p></div>
</div><p class="greenbox">Last updated on 4 July 2012 by Grégoire Dupont. More.</p>
<div><h2>Related Arguments</h2></div><div><ul><li><a href="snow.htm">Snow</a></li></ul></div></body></html>"""


def test_main_article():
    r = A.parse_article("https://e.org/ice.htm", FULL)
    assert r["title"] == "Ice is growing" and r["keywords"] == ["ice", "snow", "sea"] and r["description"] == "About ice"
    assert (r["last_update"], r["author"]) == (date(2012, 7, 4), "Grégoire Dupont")
    assert r["languages"] == [{"lang": "German", "url": "https://e.org/translation.php?a=1&l=6", "code": "de"}]
    assert r["level"] == "basic" and [x["level"] for x in r["levels"]] == ["intermediate", "basic"]
    assert r["levels"][1]["urls"] == ["https://e.org/ice.htm", "https://e.org/ice-basic.htm"]
    assert r["what_the_science_says"] == "It is melting." and r["climate_myth_source"] == {"url": "http://s.example/1", "name": "Source One"}
    assert r["at_glance"] == "First.\nSecond."
    assert r["related_arguments"] == [{"url": "https://e.org/snow.htm", "title": "Snow"}]


def test_tombstone_and_footnote_author():
    assert A.parse_article("u", "<p>Rebuttal not found</p>") == {"url": "u"}
    r = A.parse_article("u", '<div class="comment">x</div><p class="footnote padding">Translation by Ana Lopez. View</p>')
    assert r["author"] == "Ana Lopez" and r["keywords"] is None and r["climate_myth"] is None


def test_figures_take_the_next_element_as_caption():
    r = A.parse_article("u", '<h4>x</h4><p>One</p><p><img src="a.png" alt=""></p><p>Caption</p><p>Two</p><p class="greenbox">end</p><p>no</p>')
    assert r["content"] == "One\nTwo" and r["figures"] == [{"src": "a.png", "alt": None, "caption": "Caption"}]


def test_frame_overlay_and_hierarchy(spark):
    pages = spark.createDataFrame([("https://e.org/ice.htm", FULL), ("t", "Rebuttal not found"), ("n", None)], "url string, html string")
    got = {r["url"]: r for r in A.parse_pages(pages).collect()}
    assert got["t"]["lang"] is None and got["n"]["lang"] == "en" and len(got["https://e.org/ice.htm"]["levels"]) == 2
    over = {r["url"]: r for r in A.as_translated(A.parse_pages(pages)).collect()}
    assert over["https://e.org/ice.htm"]["keywords"] is None and over["t"]["lang"] is None
    nested = '<div id="mainbody"><ul><li><a href="a">A</a><ul><li><a href="b">B</a></li></ul></li><li><a href="c">C</a></li></ul></div>'
    rows = A.hierarchy(spark.createDataFrame([("p", nested)], "url string, html string"), base="https://e.org/").orderBy("node_id").collect()
    assert [(r["parent_id"], r["depth"], r["url"]) for r in rows] == [(None, 0, "https://e.org/a"), (0, 1, "https://e.org/b"), (None, 0, "https://e.org/c")]
    assert A.parse_pages(pages.limit(0)).count() == 0


def test_selectors():
    doc = tree('<div id="m"><p class="a b">1<br>2</p><ul><li>x<li>y</ul></div>')
    assert [n.text() for n in doc.select("#m > p.a.b")] == ["12"] and doc.first("p.c") is None and len(doc.select("ul li")) == 2
