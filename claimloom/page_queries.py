"""Registered queries over pages made from the driver's tables, where every field of a page is known beforehand."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Config
from .functions import text as T
from .operators import articles, classify, crawl, ingest, triples
from .queries import _register, _shared, _t, article_sql, full_articles, geography
from .schemas import ARTICLES
from .sources import rdf, store

_ID = "CAST(doc_id AS STRING)"


def _pages(spark, d) -> DataFrame:
    """An article page for each document, with parts that come and go with the document's number."""
    html = F.expr(f"""CASE WHEN doc_id % 13 = 0 THEN 'Rebuttal not found' ELSE concat(
      '<html><head><title>T', {_ID}, '</title>',
      CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('<meta name="keywords" content="k', {_ID}, ', <b>x</b>, ', lang, '">') END,
      CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('<meta name="description" content="D', {_ID}, '">') END,
      '</head><body><div id="centerColumn"><p><a title="View this argument in German" href="/de/', {_ID}, '.htm">de</a><a title="other" href="x">x</a></p></div><div id="mainbody">',
      CASE WHEN doc_id % 4 = 0 THEN concat('<table><tr><td>Select a level...</td><td><a href="/', {_ID}, '-int.htm">Intermediate</a></td><td>Basic</td></tr></table>') ELSE '' END,
      CASE WHEN doc_id % 6 = 0 THEN '<h2>x</h2>' ELSE concat('<h2>x</h2><div> S', {_ID}, ' </div>') END, '</div>',
      CASE WHEN doc_id % 2 = 0 THEN concat('<div class="comment myth">M', {_ID}, ' <a href="http://s/', {_ID}, '">Src</a></div>') ELSE concat('<div class="comment">C', {_ID}, '</div>') END,
      '<div><p>B', {_ID}, '</p><p><img src="f', {_ID}, '.png" alt=""></p><p>Cap</p><p>', md5(text), '</p></div>',
      CASE WHEN doc_id % 7 = 0 THEN concat('<div><h2>At a glance</h2><p>G1</p><p>G2</p><div class="bluebox">stop</div></div><div><div><a id="FurtherDetails"></a></div><p>F', {_ID}, '</p></div>') ELSE '' END,
      CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN '<p class="greenbox">Translation by Ana Lopez. More</p>' ELSE concat('<p class="greenbox">Last updated on 4 July 20', CAST(10 + doc_id % 10 AS STRING), ' by Bob Ray. More.</p>') END,
      '<div><h2>Related Arguments</h2></div><div><ul><li><a href="r', {_ID}, '.htm">R</a></li></ul></div></body></html>') END""")
    return _t(spark, d, "documents").select(F.expr(f"concat('http://e/a/', {_ID}, '.htm')").alias("url"), html.alias("html"), F.lit("main").alias("kind"), F.lit(None).cast("string").alias("lang"))


_FIELDS = """WITH p AS (SELECT doc_id AS i, 'http://e/a/' || doc_id || '.htm' AS url, doc_id % 13 <> 0 AS there, doc_id % 6 <> 0 AS says, doc_id % 7 = 0 AS glance, lang AS l, md5(text) AS h FROM documents)
SELECT url, CASE WHEN there THEN url END AS main_url, CASE WHEN there THEN 'en' END AS lang, CASE WHEN there THEN 'T' || i END AS title,
  CASE WHEN there AND i % 5 <> 0 THEN 'k' || i || '|x|' || l END AS keywords, CASE WHEN there AND i % 3 <> 0 THEN 'D' || i END AS description,
  CASE WHEN there THEN CASE i % 8 WHEN 0 THEN NULL WHEN 1 THEN 'Ana Lopez' ELSE 'Bob Ray' END END AS author,
  CASE WHEN there AND i % 8 > 1 THEN CAST('20' || (10 + i % 10) || '-07-04' AS DATE) END AS last_update,
  CASE WHEN there THEN 'http://e/de/' || i || '.htm' END AS language_url, CASE WHEN there THEN 'de' END AS language_code,
  CASE WHEN there AND i % 4 = 0 THEN 'basic' END AS level, CASE WHEN there THEN CASE WHEN i % 4 = 0 THEN 2 ELSE 0 END END AS n_levels,
  CASE WHEN there AND i % 4 = 0 THEN 'http://e/' || i || '-int.htm|' || url || '|http://e/a/' || i || '-basic.htm' END AS level_urls,
  CASE WHEN there AND says THEN 'S' || i END AS says, CASE WHEN there AND says THEN CASE WHEN i % 2 = 0 THEN 'M' || i || ' Src' ELSE 'C' || i END END AS myth,
  CASE WHEN there AND says AND i % 2 = 0 THEN 'http://s/' || i END AS source_url, CASE WHEN there AND says AND i % 2 = 0 THEN 'Src' END AS source_name,
  CASE WHEN there AND glance THEN 'G1' || chr(10) || 'G2' END AS at_glance, CASE WHEN there THEN CASE WHEN glance THEN 'F' || i WHEN says THEN 'B' || i || chr(10) || h ELSE '' END END AS content,
  CASE WHEN there AND says AND NOT glance THEN 'f' || i || '.png||Cap' END AS figure, CASE WHEN there THEN 'http://e/a/r' || i || '.htm|R' END AS related
FROM p"""


def _shown(rows: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, "|")
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return rows.select(
        "url", "main_url", "lang", "title", joined("keywords").alias("keywords"), "description", "author", "last_update", first("languages")["url"].alias("language_url"), first("languages")["code"].alias("language_code"), "level",
        F.when(F.col("levels").isNotNull(), F.size("levels")).alias("n_levels"), F.nullif(joined(F.flatten("levels.urls")), F.lit("")).alias("level_urls"), F.col("what_the_science_says").alias("says"), F.col("climate_myth").alias("myth"),
        F.col("climate_myth_source.url").alias("source_url"), F.col("climate_myth_source.name").alias("source_name"), "at_glance", "content",
        F.concat(first("figures")["src"], F.lit("|"), F.coalesce(first("figures")["alt"], F.lit("")), F.lit("|"), first("figures")["caption"]).alias("figure"), F.concat(first("related_arguments")["url"], F.lit("|"), first("related_arguments")["title"]).alias("related"),
    )


@_register(_FIELDS)
def article_fields(spark, d):
    """Every field of every page."""
    return _shown(articles.parse_pages(_pages(spark, d)))


def _translated(spark, d) -> DataFrame:
    html = F.expr(f"""concat('<title>Ü', {_ID}, '</title><meta name="keywords" content="k"><div id="centerColumn"><p><a title="View this argument in English" href="/a/', {_ID}, '.htm">e</a><a title="View this argument in ',
      CASE WHEN doc_id % 2 = 0 THEN 'German' ELSE 'French' END, '" href="/x/', {_ID}, '.htm">own</a></p></div><div class="comment">c</div><p class="footnote padding">Translation by Ana Lopez. View</p>')""")
    return _t(spark, d, "documents").select(F.expr(f"concat('http://e/x/', {_ID}, '.htm')").alias("url"), html.alias("html"), F.lit("language").alias("kind"), F.when(F.col("doc_id") % 3 == 0, "es").alias("lang"))


_OVERLAY = "SELECT 'http://e/x/' || doc_id || '.htm' AS url, 'http://e/a/' || doc_id || '.htm' AS main_url, CASE WHEN doc_id % 3 = 0 THEN 'es' WHEN doc_id % 2 = 0 THEN 'de' ELSE 'fr' END AS lang, 'Ü' || doc_id AS title, CAST(NULL AS VARCHAR) AS keywords, 'Ana Lopez' AS author FROM documents"


@_register(_OVERLAY)
def translated_overlay(spark, d):
    """Translated pages: the language is the one given, or else that of the entry with the page's own URL."""
    return crawl.records(_translated(spark, d)).select("url", "main_url", "lang", "title", F.array_join("keywords", "|").alias("keywords"), "author")


@_register("SELECT 'http://e/de/' || doc_id || '.htm' AS url, 'language' AS kind, 'de' AS lang FROM documents WHERE doc_id % 13 <> 0 UNION SELECT unnest(['http://e/' || doc_id || '-int.htm', 'http://e/a/' || doc_id || '.htm', 'http://e/a/' || doc_id || '-basic.htm']), 'level', 'en' FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 4 = 0")
def crawl_frontier(spark, d):
    """The pages one hop from the articles."""
    return ingest.frontier(articles.parse_pages(_pages(spark, d)))


@_register("SELECT 'http://e/a/' || doc_id || '.htm' AS url, CAST(0 AS INTEGER) AS ord, 'http://e/a/r' || doc_id || '.htm' AS href FROM documents WHERE doc_id % 13 <> 0")
def selected_anchors(spark, d):
    """Links under a selector, absolute."""
    return articles.anchors_in(_pages(spark, d), "li a")


@_register(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT 'r' || r_regionkey AS page_id, CAST(0 AS INTEGER) AS node_id, CAST(NULL AS INTEGER) AS parent_id, CAST(0 AS INTEGER) AS depth, CAST(0 AS INTEGER) AS ord, 'http://e/' || r_name AS url FROM region
UNION ALL SELECT 'r' || n_regionkey, CAST(k AS INTEGER), 0, 1, CAST(k - 1 AS INTEGER), 'http://e/' || n_name FROM n
UNION ALL SELECT 'r' || r_regionkey, CAST(1 + (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS INTEGER), NULL, 0, 1, NULL FROM region"""
)
def hierarchy_lists(spark, d):
    """Nested lists of links, flattened: regions over nations, and an item without a link."""
    n = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit('<li><a href="'), x["n_name"], F.lit('">x</a></li>'))), "").alias("items"))
    r = _t(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    html = F.concat(F.lit('<div id="mainbody"><p>x</p><ul><li><a href="'), "r_name", F.lit('">R</a><ul>'), F.coalesce("items", F.lit("")), F.lit("</ul></li><li>bare</li></ul></div>"))
    return articles.hierarchy(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("url"), html.alias("html")), base="http://e/")


@_register("SELECT url, CASE WHEN page_id % 3 = 0 THEN 'kept ' || url ELSE 'page ' || url END AS html FROM pages WHERE page_id % 3 = 0 OR length(url) % 7 <> 0")
def crawl_cached(spark, d):
    """Pages through the cache: what is fresh is not asked for, what fails is left out and noted."""
    now, path = datetime(2024, 1, 1, 12), _shared(spark)
    # several pages may have one URL: each is asked for under its own number
    p = _t(spark, d, "pages").withColumn("own", F.concat("url", F.lit("#page="), F.col("page_id").cast("string")))
    at = F.when(F.col("page_id") % 2 == 0, F.lit(now) - F.expr("INTERVAL 10 MINUTES")).otherwise(F.lit(now))
    p.where("page_id % 3 = 0").select(F.md5(F.col("own").cast("binary")).alias("url_hash"), F.concat(F.lit("kept "), "url").alias("content"), at.alias("fetched_at")).write.parquet(path)

    def get(own: str) -> tuple[int, str]:
        url = own.rpartition("#page=")[0]
        return (404, "") if len(url) % 7 == 0 else (200, f"page {url}")

    found = crawl.cached(p.select(F.col("own").alias("url")), path, now, 3600, get, strict=False)
    return p.select("own", "url").join(found.withColumnRenamed("url", "own"), "own").select("url", "html")


@_register("SELECT 'http://e/a/' || doc_id || '.htm' AS url, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'T' || doc_id END AS title, CASE WHEN doc_id % 4 = 1 THEN '1_1' END AS category, CASE WHEN doc_id % 4 = 1 THEN 'set' ELSE 'absent' END AS category_state FROM documents")
def stored_articles(spark, d):
    """Parsed pages merged into a stored table that is replaced, twice: categories stay."""
    path = _shared(spark)
    fresh = crawl.records(_pages(spark, d)).withColumns({"category": F.lit(None).cast("string"), "category_state": F.lit("absent")})
    fresh.write.parquet(f"{path}_fresh")  # parsed once, merged twice
    fresh = spark.read.schema(fresh.schema).parquet(f"{path}_fresh")
    number = F.regexp_extract("url", "([0-9]+)[.]htm$", 1).cast("long")
    once = ingest.upsert(store.stored(spark, path, ARTICLES), fresh, "url")
    store.replace(once.withColumns({"category": F.when(number % 4 == 1, "1_1"), "category_state": F.when(number % 4 == 1, "set").otherwise("absent")}).select(*once.columns), path)
    store.replace(ingest.upsert(store.stored(spark, path, ARTICLES), fresh, "url"), path)
    return store.stored(spark, path, ARTICLES).select("url", "title", "category", "category_state")


@_register("SELECT doc_id, CASE WHEN md5(text) < '8' THEN '0' WHEN md5(text) < 'c' THEN '5_3' ELSE '1_2' END AS category FROM documents")
def two_stage_models(spark, d):
    """Two models in a row: the second sees what the first lets through."""
    binary = lambda: lambda xs: [[1.0, 0.0] if x < "8" else [0.0, 1.0] for x in xs]
    classes = lambda: lambda xs: [[0.0] * 17 + [1.0] if x < "c" else [0.0, 1.0] + [0.0] * 16 for x in xs]
    docs = _t(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("t"))
    return classify.two_stage(docs, "t", binary, classes).select("doc_id", "category")


_GEOGRAPHY = """SELECT 'http://g/nation/' || n_nationkey AS s, 'iri' AS s_kind, 'http://g/in' AS p, 'http://g/region/' || n_regionkey AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang FROM nation
UNION ALL SELECT 'http://g/nation/' || n_nationkey, 'iri', 'http://g/name', n_name, 'literal', NULL, NULL FROM nation UNION ALL SELECT 'http://g/region/' || r_regionkey, 'iri', 'http://g/name', r_name, 'literal', NULL, NULL FROM region
UNION ALL SELECT 'http://g/customer/' || c_custkey, 'iri', 'http://g/of', 'http://g/nation/' || c_nationkey, 'iri', NULL, NULL FROM customer UNION ALL SELECT 'http://g/customer/' || c_custkey, 'iri', 'http://g/segment', c_mktsegment, 'literal', NULL, NULL FROM customer
UNION ALL SELECT 'http://g/customer/' || c_custkey, 'iri', 'http://g/size', CAST(c_custkey % 50 AS VARCHAR), 'literal', 'http://www.w3.org/2001/XMLSchema#integer', NULL FROM customer
UNION ALL SELECT 'http://g/customer/' || c_custkey, 'iri', 'http://g/vip', 'true', 'literal', 'http://www.w3.org/2001/XMLSchema#boolean', NULL FROM customer WHERE c_custkey % 4 = 0"""


@_register(_GEOGRAPHY)
def ntriples_roundtrip(spark, d):
    path = _shared(spark)
    rdf.write_ntriples(geography(spark, d), path)
    return rdf.read_ntriples(spark, path)


@_register(article_sql("text"))
def article_graph_roundtrip(spark, d):
    """The whole graph of articles whose bodies are whole texts, written as N-Quads and read back."""
    path = _shared(spark)
    graph = triples.graph(triples.article_triples(full_articles(spark, d, F.col("text")), Config()))
    rdf.write_nquads(graph.withColumn("g", F.lit("http://g/articles")), path)
    return rdf.read_nquads(spark, path, strict=True).where("g = 'http://g/articles'").drop("g")


@_register(_GEOGRAPHY)
def turtle_roundtrip(spark, d):
    path = _shared(spark)
    rdf.write_turtle(geography(spark, d), path, {"g": "http://g/", "xsd": "http://www.w3.org/2001/XMLSchema#"})
    return rdf.read_turtle(spark, path)


def _roundtrip(form: str):
    def run(spark, d):
        path = _shared(spark)
        rdf.write_rdf(geography(spark, d), path, form, {"g": "http://g/"})
        return rdf.read_rdf(spark, path, form).select("s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang")

    return run


for _form in ("nq", "xml", "json-ld"):
    _register(_GEOGRAPHY, f"{_form.replace('-', '')}_roundtrip")(_roundtrip(_form))


_LISTS = ", ".join(f"{{'lang': '{lang}', 'k': {k}, 'n': len(list_intersect(ws, [" + ", ".join(f"'{w}'" for w in words.split()) + "]))}" for k, (lang, words) in enumerate(T.LANGUAGE_WORDS.items()))


@_register(f"WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL]+')) AS ws FROM documents), v AS (SELECT doc_id, unnest([{_LISTS}]) AS x FROM w) SELECT doc_id, CASE WHEN max(x.n) > 0 THEN arg_max(x.lang, x.n * 100 - x.k) END AS detected FROM v GROUP BY doc_id")
def doc_detect_language(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.detect_language(F.col("text")).alias("detected"))


@_register("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS name, lang AS code FROM documents")
def language_names(spark, d):
    """Names of languages, and their codes from the names again."""
    return _t(spark, d, "documents").select("doc_id", T.language_name(F.col("lang")).alias("name")).withColumn("code", T.language_code(F.upper("name")))
