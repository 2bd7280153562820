"""The crawl from index pages to stored articles, and the departures that the article parser once had."""

import argparse
import json
from datetime import date
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread

import pytest

from claimloom import cli
from claimloom.config import Config
from claimloom.operators import articles as A
from claimloom.operators import concepts, crawl, stats
from claimloom.schemas import ARTICLES
from claimloom.sources import store

MAIN = """<title>Ice</title><div id="centerColumn"><p><a title="View this argument in German" href="/de/ice.htm">de</a></p></div>
<div id="mainbody"><table><tr><td>Select a level...</td><td>Basic</td><td><a href="/ice-advanced.htm">Advanced</a></td></tr></table><h2>x</h2><div>It melts.</div></div><div class="comment myth">Ice isn't melting</div><div><p>Body</p></div>"""
GERMAN = """<title>Eis</title><div id="centerColumn"><p><a title="View this argument in English" href="/ice.htm">en</a><a title="View this argument in German" href="/de/ice.htm">de</a></p></div>
<div id="mainbody"><h2>x</h2><div>Es schmilzt.</div></div><div class="comment">Eis</div><div><p>Text</p></div><p class="footnote padding">Translation by Ana Lopez. View</p>"""
SITE = {
    "http://e/list": '<div id="mainbody"><table><tr><td><a href="/ice.htm">1</a><a href="skip.htm">2</a><a href="ice.htm">3</a></td></tr></table><p><a href="/not.htm">no</a></p></div>',
    "http://e/ice.htm": MAIN,
    "http://e/ice-basic.htm": MAIN.replace("<title>Ice", "<title>Ice, basic"),
    "http://e/ice-advanced.htm": "<title>Ice, advanced</title>",
    "http://e/de/ice.htm": GERMAN,
}


def test_from_index_to_articles(spark, tmp_path):
    asked = []

    def get(url):
        asked.append(url)
        return (200, SITE[url]) if url in SITE else (404, "")

    here = str(tmp_path)
    args = argparse.Namespace(urls=None, index=[("http://e/list", "#mainbody table a")], cache=f"{here}/cache", pages=f"{here}/pages", endpoint=None, claims=None, lenient=False)
    cli.collect(spark, Config(ignore_urls=("http://e/skip.htm",)), args, get)
    pages = {(r["url"], r["kind"], r["lang"]) for r in spark.read.parquet(f"{here}/pages").collect()}
    assert pages == {("http://e/ice.htm", "main", None), ("http://e/ice.htm", "level", None), ("http://e/ice-basic.htm", "level", None), ("http://e/ice-advanced.htm", "level", None), ("http://e/de/ice.htm", "language", "de")}
    for _ in range(2):
        assert cli.main(["process", f"{here}/pages", "--taxonomy", "builtin", "--articles-db", f"{here}/a"], spark) == 0
    got = {r["url"]: r for r in store.stored(spark, f"{here}/a", ARTICLES).collect()}
    assert len(got) == 4 and store.exists(spark, f"{here}/a") and not store.exists(spark, f"{here}/a.old")
    german = got["http://e/de/ice.htm"]
    assert (german["lang"], german["main_url"], german["levels"], german["author"], german["category_state"]) == ("de", "http://e/ice.htm", None, "Ana Lopez", "absent")
    assert (got["http://e/ice.htm"]["category"], got["http://e/ice.htm"]["category_state"]) == ("1_1", "set") and got["http://e/ice-advanced.htm"]["category_state"] == "absent"


def test_failed_pages_are_kept_as_errors(spark, tmp_path):
    from datetime import datetime

    urls = spark.createDataFrame([("http://e/ice.htm",), ("http://e/gone",)], "url string")
    get = lambda u: (200, SITE[u]) if u in SITE else (404, "")
    path = str(tmp_path / "c")
    assert crawl.cached(urls, path, datetime(2024, 1, 1), 3600, get, strict=False).count() == 1
    assert [(r["url"], r["status"]) for r in spark.read.parquet(path + "_failed").collect()] == [("http://e/gone", 404)]
    with pytest.raises(RuntimeError, match="gone"):
        crawl.cached(urls, path, datetime(2024, 1, 1), 3600, get, strict=True)


def test_claims_of_a_remote_endpoint(spark, tmp_path):
    rows = [{"rev": {"value": "http://r/1"}, "date_published": {"value": "2024"}, "text": {"value": "Ice grows"}}]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"results": {"bindings": rows}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        out = str(tmp_path / "claims")
        args = argparse.Namespace(urls=None, index=[], cache=str(tmp_path / "c"), pages=None, endpoint=f"http://127.0.0.1:{server.server_port}/", claims=out, lenient=False)
        cli.collect(spark, Config(), args)
        assert [tuple(r) for r in spark.read.json(out).select("rev", "date_published", "text").collect()] == [("http://r/1", "2024", "Ice grows")]
    finally:
        server.shutdown()


def test_a_replacement_that_stopped_is_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace(spark.range(3).toDF("x"), path)
    store.replace(spark.read.parquet(path).where("x > 0"), path)
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert store.stored(spark, path, "x long").count() == 2


SAYS = '<div id="mainbody"><h2>x</h2><div>It melts.</div></div>'


def test_author_of_the_footnote_where_the_box_names_none():
    r = A.parse_article("u", '<p class="greenbox">Last updated on 4 July 2012.</p><div class="comment">x</div><p class="footnote padding">Translation by Ana Lopez. View</p>')
    assert (r["last_update"], r["author"]) == (date(2012, 7, 4), "Ana Lopez")
    r = A.parse_article("u", '<p class="greenbox">Translation by Zoé Müller. More</p><p class="greenbox">Last updated on 4 July 2012 by X Y.</p>')
    assert (r["last_update"], r["author"]) == (None, "Zoé Müller")


def test_no_h4_under_a_page_that_says_something():
    assert A.parse_article("u", SAYS + "<h4>x</h4><p>One</p>")["content"] == ""
    assert A.parse_article("u", "<h4>x</h4><p>One</p>")["content"] == "One"


def test_myth_needs_a_text_above_it_and_its_source_a_target():
    empty = '<div id="mainbody"><h2>x</h2><div> </div></div><div class="comment myth">M</div>'
    assert A.parse_article("u", empty)["climate_myth"] is None
    r = A.parse_article("u", SAYS + '<div class="comment myth">M <a>no target</a></div><div><p>B</p></div>')
    assert r["climate_myth"] == "M no target" and r["climate_myth_source"] is None and r["content"] == "B"
    r = A.parse_article("u", SAYS + '<div class="comment">ﬁne <a href="s">ﬁrst</a></div><p>no</p><div><p>B</p></div>')
    assert r["climate_myth"] == "fine first" and r["climate_myth_source"] == {"url": "s", "name": "ﬁrst"} and r["content"] == "B"


def test_builtin_taxonomy(spark):
    rows = concepts.concepts(spark, "n#").collect()
    assert len(rows) == 82 and [sum(r["id"].count("_") == k for r in rows) for k in range(3)] == [6, 27, 49]
    assert [r["id"] for r in sorted(rows, key=lambda r: r["ord"])] == [i for i, _, _ in concepts.listed()]
    assert concepts.concept_triples(spark, "n#").distinct().count() == 413


def test_tree_lines_tell_all_nodes(spark):
    nodes = spark.range(12_000).selectExpr("'p' AS page_id", "CAST(id AS INT) AS node_id", "0 AS depth", "CAST(id AS STRING) AS url")
    lines = list(stats.tree_lines(nodes))
    assert len(lines) == 12_001 and lines[-1] == "total: 12000"
