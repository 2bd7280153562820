"""The registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import text as T
from .functions import urls as U
from .operators import articles, classify, concepts, ingest, stats, triples
from .plans.sparql import query as sparql
from .schemas import TRIPLES

Q: dict = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None, name: str | None = None):
    def add(f):
        Q[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _shared(spark) -> str:
    """A folder for a query that writes and reads back."""
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='claimloom_')}/{uuid.uuid4().hex}"


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[\\pL]+')), lambda w: NOT list_contains(" + _STOP + ", w))"


# -- pages and URLs
@_register("SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, hs[i] AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS hs FROM pages), unnest(range(1, len(hs) + 1)) AS r(i)")
def page_anchors(spark, d):
    return articles.anchors(_t(spark, d, "pages"), "page_id")


@_register("SELECT page_id, md5(regexp_replace(html, '<.*?>', '', 'g')) AS text_md5 FROM pages")
def page_strip_tags(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(T.strip_tags(F.col("html")).cast("binary")).alias("text_md5"))


@_register("SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, 'lang=\"([^\"]*)\"', 1), '') AS lang, nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') AS host FROM pages")
def page_title_lang_host(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", T.extract(F.col("html"), "<title>([^<]*)</title>").alias("title"), T.extract(F.col("html"), 'lang="([^"]*)"').alias("lang"), U.host(F.col("url")).alias("host")).withColumns(
        {c: F.nullif(F.col(c), F.lit("")) for c in ("title", "lang")}
    )


@_register("SELECT page_id, replace(url || '.htm', '.htm', '-basic.htm') AS level_url FROM pages")
def page_level_url(spark, d):
    return _t(spark, d, "pages").select("page_id", U.level_url(F.concat("url", F.lit(".htm")), F.lit("Basic")).alias("level_url"))


@_register(
    """SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, CASE
  WHEN regexp_matches(h, '(^|/)\\.\\.?(/|$|\\?|#)') THEN NULL
  WHEN h = '' THEN url WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h
  WHEN starts_with(h, '//') THEN regexp_extract(url, '^([^/]+)//', 1) || h
  WHEN starts_with(h, '/') THEN regexp_extract(url, '^([^/?#]+//[^/?#]*)', 1) || h
  WHEN starts_with(h, '#') THEN regexp_replace(url, '#.*$', '') || h
  WHEN starts_with(h, '?') THEN regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') || h
  ELSE CASE WHEN regexp_matches(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', ''), '^[^/]+//[^/]*$')
    THEN regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') || '/' ELSE regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', ''), '[^/]*$', '') END || h END AS target
FROM (SELECT page_id, url, i, hs[i] AS h FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages), unnest(range(1, len(hs) + 1)) AS r(i))"""
)
def page_urljoin(spark, d):
    p = _t(spark, d, "pages")
    links = p.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "href"))
    return links.select("page_id", "ord", U.join_simple(F.col("url"), F.col("href")).alias("target"))


@_register("SELECT DISTINCT url FROM pages")
def distinct_sorted_urls(spark, d):
    return ingest.discovered(_t(spark, d, "pages"))


@_register("SELECT url FROM pages UNION SELECT url || '?p=' || page_id FROM pages EXCEPT SELECT url FROM pages WHERE page_id % 7 = 0")
def url_union_except(spark, d):
    p = _t(spark, d, "pages")
    other = p.select(F.concat("url", F.lit("?p="), F.col("page_id").cast("string")).alias("url"))
    union = p.select("url").unionByName(other).distinct()
    return ingest.not_stored(union, p.where("page_id % 7 = 0"), "url")


@_register("SELECT url, 'en' AS lang, regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&amp;?', '&', 'g') AS title, CAST(0 AS INTEGER) AS n_related, '' AS content FROM pages")
def article_parse(spark, d):
    return articles.parse_pages(_t(spark, d, "pages")).select("url", "lang", "title", F.size("related_arguments").alias("n_related"), "content")


@_register()
def page_hierarchy(spark, d):
    return articles.hierarchy(_t(spark, d, "pages"), "ul")


# -- text
@_register(f"SELECT doc_id, CAST(len({_TOKENS.format('text')}) AS BIGINT) AS n_tokens FROM documents")
def doc_token_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(T.clean_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@_register("SELECT doc_id, left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 256) AS head, CAST(length(left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 256)) AS BIGINT) AS n FROM documents")
def doc_prefix_strip(spark, d):
    head = T.window(F.col("text"), 256)
    return _t(spark, d, "documents").select("doc_id", head.alias("head"), F.length(head).cast("long").alias("n"))


@_register("SELECT doc_id, 'claimreview_' || md5(text) AS id FROM documents")
def doc_md5_id(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.md5_id(F.col("text"), "claimreview_").alias("id"))


@_register("SELECT doc_id, source FROM documents WHERE lang = 'en'")
def doc_lang_filter(spark, d):
    return _t(spark, d, "documents").where(F.col("lang") == "en").select("doc_id", "source")


@_register("SELECT nullif(lang, 'es') AS value, count(*) AS n FROM documents GROUP BY 1")
def doc_lang_counts(spark, d):
    return stats.value_counts(_t(spark, d, "documents").withColumn("lang", F.nullif(F.col("lang"), F.lit("es"))), "lang")


@_register("SELECT count(*) AS distinct_values, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE value IS NOT NULL AND value <> 'fr') AS BIGINT) AS total_without FROM (SELECT nullif(lang, 'es') AS value, count(*) AS n FROM documents GROUP BY 1)")
def doc_total_excluding(spark, d):
    return stats.summary(doc_lang_counts(spark, d), ("fr",))


@_register("SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY text")
def doc_first_per_text(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    return ingest.first_per_key(docs, "key", F.col("doc_id"))


@_register()
def nfkd_content(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.nfkd("text").cast("binary")).alias("nfkd_md5"))


@_register("SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS DATE) AS day FROM orders")
def date_parse_long(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", T.long_date(F.date_format("o_orderdate", "d MMMM yyyy")).alias("day"))


@_register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# -- ingestion
@_register("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def claims_anti_join(spark, d):
    return ingest.not_stored(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id")


_STORED = "SELECT doc_id AS id, CAST(quality AS VARCHAR) AS category, 'set' AS category_state, 'old' AS title FROM labels"


@_register(
    f"""SELECT coalesce(n.doc_id, o.id) AS id, CASE WHEN n.doc_id IS NULL OR o.id IS NOT NULL THEN o.category END AS category,
  coalesce(CASE WHEN n.doc_id IS NULL OR o.id IS NOT NULL THEN o.category_state END, 'absent') AS category_state, CASE WHEN n.doc_id IS NOT NULL THEN n.source ELSE o.title END AS title
FROM ({_STORED}) o FULL OUTER JOIN (SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0) n ON o.id = n.doc_id"""
)
def merge_upsert(spark, d):
    stored = _t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("category"), F.lit("set").alias("category_state"), F.lit("old").alias("title"))
    new = _t(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.col("source").alias("title"))
    return ingest.upsert(stored, new, "id")


@_register("SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src3')")
def ignore_list(spark, d):
    return ingest.without(_t(spark, d, "documents").select("doc_id", "source"), "source", ["src0", "src3"])


@_register("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def top100_recent_events(spark, d):
    return _t(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(100)


@_register("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_event_per_user(spark, d):
    return ingest.last_per_key(_t(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts").select("user_id", "event_id")


@_register("SELECT doc_id, w AS keyword FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)")
def keywords_explode(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ", -1)).alias("keyword"))


@_register("SELECT DISTINCT 'u' || p_partkey || '/' || lv AS url, 'level' AS kind, 'en' AS lang FROM part, unnest(['basic', 'advanced']) AS t(lv)")
def nested_levels_explode(spark, d):
    p = _t(spark, d, "part")
    u = F.concat(F.lit("u"), F.col("p_partkey").cast("string"), F.lit("/"))
    levels = F.array(*[F.struct(F.lit(x).alias("level"), F.array(F.concat(u, F.lit(x))).alias("urls")) for x in ("basic", "advanced")])
    return ingest.frontier(p.select(levels.alias("levels"), F.array().cast("array<struct<lang: string, url: string, code: string>>").alias("languages")))


@_register("SELECT p_partkey FROM part WHERE p_size IS NULL OR p_size % 3 = 0 OR p_size % 2 = 0")
def first_level_filter(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "de").otherwise("en").alias("lang"), F.lit("basic").alias("level"),
                                    F.array(F.struct(F.when(F.col("p_size") % 2 == 0, "basic").otherwise("advanced").alias("level"))).alias("levels"))
    return p.where(triples.level_ok()).select("p_partkey")


@_register("SELECT conv_id, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS caption FROM conversations")
def caption_lead(spark, d):
    from pyspark.sql import Window

    return _t(spark, d, "conversations").select("conv_id", "turn", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("caption"))


@_register("SELECT conv_id, turn FROM (SELECT *, max(CASE WHEN length(text) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS stop FROM conversations) WHERE stop = 0")
def take_while_marker(spark, d):
    from pyspark.sql import Window

    stop = F.max(F.when(F.length("text") > 400, 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return _t(spark, d, "conversations").withColumn("stop", stop).where("stop = 0").select("conv_id", "turn")


@_register("SELECT DISTINCT CAST(user_id AS VARCHAR) AS url FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND")
def cache_ttl_hits(spark, d):
    e = _t(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    cache = e.select(F.md5(F.col("user_id").cast("string").cast("binary")).alias("url_hash"), F.lit("x").alias("content"), F.col("ts").alias("fetched_at"))
    return ingest.cache_split(e.select(F.col("user_id").cast("string").alias("url")), cache, F.lit(now).cast("timestamp_ntz"), 3600)[0].select("url")


# -- matching
_PAIRS = f"""WITH l AS (SELECT doc_id, {_TOKENS.format("text")} AS a FROM documents), r AS (SELECT item_id, {_TOKENS.format("text")} AS b FROM benchmark),
p AS (SELECT doc_id, item_id, len(list_intersect(a, b)) AS k, len(a) AS n, len(b) AS m FROM l, r),
s AS (SELECT doc_id, item_id, CASE WHEN n + m - k = 0 THEN 0.0::DOUBLE ELSE k::DOUBLE / (n + m - k)::DOUBLE END AS similarity FROM p) """


def _match_inputs(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text"), _t(spark, d, "benchmark")


@_register(_PAIRS + "SELECT doc_id AS key, item_id AS label_id, item_id AS ord, similarity FROM s")
def jaccard_cross(spark, d):
    return classify.all_scores(*_match_inputs(spark, d), "doc_id", "text", "item_id", "text", "item_id")


@_register(_PAIRS + "SELECT doc_id AS key, item_id AS label_id, item_id AS ord, similarity FROM s WHERE similarity > 0")
def jaccard_inverted(spark, d):
    return classify.scores(*_match_inputs(spark, d), "doc_id", "text", "item_id", "text", "item_id")


@_register(
    _PAIRS
    + ", b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id) AS r FROM s) SELECT doc_id AS key, CASE WHEN similarity >= 0.05 AND similarity > 0 THEN CAST(item_id AS VARCHAR) ELSE '0' END AS category, similarity FROM b WHERE r = 1"
)
def jaccard_best_match(spark, d):
    return classify.best_match(*_match_inputs(spark, d), "doc_id", "text", "item_id", "text", "item_id", 0.05)


_LEAST = 0.2


@_register(_PAIRS + f"SELECT doc_id AS key, item_id AS label_id, item_id AS ord, similarity FROM s WHERE similarity >= {_LEAST}")
def jaccard_at_least(spark, d):
    """All pairs over a threshold, through the rare tokens of each side."""
    return classify.similar(*_match_inputs(spark, d), "doc_id", "text", "item_id", "text", "item_id", _LEAST)


@_register(
    _PAIRS
    + f", b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id) AS r FROM s) SELECT doc_id AS key, CASE WHEN similarity >= {_LEAST} THEN CAST(item_id AS VARCHAR) ELSE '0' END AS category, CASE WHEN similarity >= {_LEAST} THEN similarity ELSE 0.0 END AS similarity FROM b WHERE r = 1"
)
def jaccard_best_at_least(spark, d):
    return classify.best_match(*_match_inputs(spark, d), "doc_id", "text", "item_id", "text", "item_id", _LEAST, below=False)


_NAMES = "[" + ", ".join(f"'{x}'" for x in classify.CLASS_LABELS) + "]"


@_register(f"SELECT vec_id, CASE WHEN embedding[1] >= embedding[2] THEN '0' ELSE {_NAMES}[list_position(embedding[3:20], list_max(embedding[3:20]))] END AS category FROM embeddings")
def two_stage_gate(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", classify.gate(F.slice("embedding", 1, 2), F.slice("embedding", 3, 18)).alias("category"))


# -- graphs
_N = Config().namespace


def _docs_as_articles(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    none = lambda t: F.lit(None).cast(t)
    url = F.concat(F.lit("http://d/"), F.col("doc_id").cast("string"))
    return docs.join(labels, "doc_id", "left").select(
        url.alias("url"), url.alias("main_url"), none("string").alias("level"), "lang", F.col("source").alias("title"), F.array(F.col("source"), F.col("lang")).alias("keywords"), none("string").alias("description"),
        none("string").alias("author"), none("date").alias("last_update"), none("array<struct<lang: string, url: string, code: string>>").alias("languages"), none("array<struct<level: string, urls: array<string>>>").alias("levels"),
        none("string").alias("what_the_science_says"), F.md5(F.col("text").cast("binary")).alias("climate_myth"), none("struct<url: string, name: string>").alias("climate_myth_source"), none("string").alias("at_glance"),
        none("string").alias("content"), none("array<struct<url: string, title: string>>").alias("related_arguments"), F.col("quality").cast("string").alias("category"),
    )


@_register(
    """WITH d AS (SELECT 'http://d/' || doc_id AS url, lang, source, md5(text) AS myth, quality FROM documents LEFT JOIN labels USING (doc_id)),
t AS (SELECT 'type' AS k, md5(url) AS x FROM d UNION SELECT 'kw', md5(url) || source FROM d UNION SELECT 'kw', md5(url) || lang FROM d),
n AS (SELECT count(DISTINCT url) AS docs, count(DISTINCT url) FILTER (WHERE quality IS NOT NULL) AS rated, count(DISTINCT lang) AS langs FROM d)
SELECT 'https://schema.org/keywords' AS p, (SELECT count(*) FROM t WHERE k = 'kw') AS n UNION ALL SELECT 'https://schema.org/about', rated FROM n UNION ALL SELECT 'https://schema.org/subjectOf', rated FROM n
UNION ALL SELECT 'https://schema.org/claimReviewed', docs FROM n UNION ALL SELECT 'https://schema.org/text', docs FROM n UNION ALL SELECT 'https://schema.org/inLanguage', docs FROM n"""
)
def review_triples(spark, d):
    found = triples.graph(triples.article_triples(_docs_as_articles(spark, d), Config()))
    shown = ["keywords", "about", "subjectOf", "claimReviewed", "text", "inLanguage"]
    return found.where(F.col("p").isin(["https://schema.org/" + x for x in shown])).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


#: Articles with a value in every column, on every side of every condition, as SQL over documents and labels.
_FULL = """WITH a AS (SELECT doc_id AS i, 'http://d/' || doc_id AS url, 'http://d/' || (doc_id - CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS main_url,
  CASE doc_id % 9 WHEN 0 THEN 'advanced' WHEN 1 THEN 'basic' END AS level, CASE WHEN doc_id % 50 <> 49 THEN lang END AS lang, CASE WHEN doc_id % 8 <> 0 THEN source END AS title,
  CASE WHEN doc_id % 3 <> 0 THEN 'd' || md5(text) END AS description, CASE WHEN doc_id % 4 <> 0 THEN 'Author ' || (doc_id % 7) END AS author,
  CASE WHEN doc_id % 6 <> 0 THEN CAST(DATE '2020-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) END AS last_update,
  CASE WHEN doc_id % 10 <> 0 THEN 'w' || doc_id END AS says, CASE WHEN doc_id % 11 <> 0 THEN md5(text) END AS myth, CASE WHEN doc_id % 2 = 1 THEN 'http://d/' || doc_id || '/s' END AS cited,
  CASE WHEN doc_id % 3 = 1 THEN 'g' || doc_id END AS glance, CASE WHEN doc_id % 7 <> 0 THEN 'c' || md5(text) END AS content,
  CASE WHEN toxic = 1 THEN '0_0' ELSE CAST(quality AS VARCHAR) END AS category, source AS k1, documents.lang AS k2
  FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT *, {N} || 'claimreview_' || md5(url) AS r, {N} || 'claimreview_' || md5(main_url) AS m, '_:rating_' || md5(url) AS b, {N} || 'person_' || md5(author) AS person,
  CASE WHEN category <> '0_0' THEN {N} || category END AS concept, {N} || 'organization_site' AS site
  FROM a WHERE lang IS NOT NULL AND (level IS NULL OR lang <> 'en' OR level = 'basic'))
"""
_SDO, _RDFT = "'https://schema.org/{0}'", "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"


def _template(s: str, p: str, o: str, kind: str = "iri", dt: str = "", lang: str = "", s_kind: str = "iri", where: str = "TRUE") -> str:
    name = _RDFT if p == "type" else p if ":" in p else _SDO.format(p)
    return f"SELECT {s} AS s, '{s_kind}' AS s_kind, {name} AS p, {o} AS o, '{kind}' AS o_kind, {_SDO.format(dt) if dt else 'CAST(NULL AS VARCHAR)'} AS o_datatype, {lang or 'CAST(NULL AS VARCHAR)'} AS o_lang FROM v WHERE {where} AND {s} IS NOT NULL AND {o} IS NOT NULL"


def article_sql(body: str = "'c' || md5(text)") -> str:
    """All triples of the articles of ``full_articles`` with that body."""
    lit = lambda s, p, o, **k: _template(s, p, o, "literal", **k)
    of = lambda x: _SDO.format(x)
    near = "{N} || 'claimreview_' || md5('http://d/' || (i + 1))"
    rows = [
        _template("r", "type", of("ClaimReview")), lit("r", "url", "url", dt="URL"), _template("r", "reviewRating", "b", "bnode"), _template("b", "type", of("Rating"), s_kind="bnode"),
        *[lit("b", p, f"'{x}'", dt="Number", s_kind="bnode") for p, x in (("ratingValue", 0), ("bestRating", 1), ("worstRating", 0))],
        lit("b", "ratingExplanation", "says", lang="lang", s_kind="bnode"), lit("b", "name", "'False'", dt="Text", s_kind="bnode"), lit("r", "dateCreated", "strftime(last_update, '%Y-%m-%dT%H:%M:%S')", dt="Date"),
        lit("r", "inLanguage", "CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END", dt="Text"),
        _template("r", "author", "person"), _template("person", "type", of("Person")), lit("person", "name", "author", dt="Text"), _template("r", "publisher", "site"), _template("site", "type", of("Organization")),
        lit("site", "name", "'Fact check site'", lang="lang"), lit("site", "url", "'https://example.org/'", dt="URL"), lit("r", "license", "'https://creativecommons.org/licenses/by/3.0/'", dt="URL"),
        lit("r", "description", "description", lang="lang"), lit("r", "abstract", "glance", lang="lang"), _template("r", "about", "concept"), _template("concept", "subjectOf", "r"),
        lit("r", "name", "title", lang="lang"), lit("r", "headline", "says", lang="lang"), lit("r", "reviewBody", "content", lang="lang"), lit("r", "text", "content", lang="lang"),
        _template("r", "'http://www.w3.org/2002/07/owl#sameAs'", "m", where="main_url <> url"), _template("r", "claimReviewed", "m"), _template("m", "type", of("Claim")), lit("m", "text", "myth", lang="lang"), lit("m", "citation", "cited", dt="URL"),
        lit("r", "keywords", "k1", lang="lang"), lit("r", "keywords", "k2", lang="lang"), _template("r", "associatedClaimReview", near, where="i % 4 = 1"), _template("r", "'http://www.w3.org/2000/01/rdf-schema#seeAlso'", near, where="i % 4 = 1"),
        _template("{N} || 'de'", "type", of("Language"), where="i % 2 = 0"), lit("{N} || 'de'", "alternateName", "'de'", dt="Text", where="i % 2 = 0"), lit("{N} || 'de'", "name", "'German'", lang="lang", where="i % 2 = 0"),
    ]
    return (_FULL.replace("'c' || md5(text)", body) + " UNION ".join(rows)).replace("{N}", f"'{_N}'")


def full_articles(spark, d, body=None):
    """The same articles as columns."""
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    i, text = F.col("doc_id"), lambda prefix: F.concat(F.lit(prefix), F.md5(F.col("text").cast("binary")))
    url = lambda n: F.concat(F.lit("http://d/"), n.cast("string"))
    numbered = lambda prefix: F.concat(F.lit(prefix), i.cast("string"))
    return docs.select(
        url(i).alias("url"), url(i - F.when(i % 5 == 0, 1).otherwise(0)).alias("main_url"), F.when(i % 9 == 0, "advanced").when(i % 9 == 1, "basic").alias("level"), F.when(i % 50 != 49, F.col("lang")).alias("lang"),
        F.when(i % 8 != 0, F.col("source")).alias("title"), F.array("source", "lang").alias("keywords"), F.when(i % 3 != 0, text("d")).alias("description"),
        F.when(i % 4 != 0, F.concat(F.lit("Author "), (i % 7).cast("string"))).alias("author"), F.when(i % 6 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (i % 365).cast("int"))).alias("last_update"),
        F.when(i % 2 == 0, F.array(F.struct(F.lit("German").alias("lang"), F.concat(url(i), F.lit("/de")).alias("url"), F.lit("de").alias("code")))).alias("languages"),
        F.array(F.struct(F.lit("basic").alias("level"), F.array(url(i)).alias("urls"))).alias("levels"), F.when(i % 10 != 0, numbered("w")).alias("what_the_science_says"), F.when(i % 11 != 0, text("")).alias("climate_myth"),
        F.when(i % 2 == 1, F.struct(F.concat(url(i), F.lit("/s")).alias("url"), F.lit("S").alias("name"))).alias("climate_myth_source"), F.when(i % 3 == 1, numbered("g")).alias("at_glance"), F.when(i % 7 != 0, text("c") if body is None else body).alias("content"),
        F.when(i % 4 == 1, F.array(F.struct(url(i + 1).alias("url"), F.lit("x").alias("title")))).alias("related_arguments"), F.when(F.col("toxic") == 1, "0_0").otherwise(F.col("quality").cast("string")).alias("category"),
    )


@_register(article_sql())
def article_templates(spark, d):
    """All triples of all templates, row by row."""
    return triples.graph(triples.article_triples(full_articles(spark, d), Config()))


def _mappings(spark, d):
    return _t(spark, d, "labels").select(F.concat(F.lit("http://c/"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("toxic") == 1, "1_1").otherwise("0_0").alias("category"))


@_register(f"SELECT 'http://c/' || doc_id AS s, 'https://schema.org/about' AS p, '{_N}1_1' AS o FROM labels WHERE toxic = 1 UNION SELECT '{_N}1_1', 'https://schema.org/subjectOf', 'http://c/' || doc_id FROM labels WHERE toxic = 1")
def mapping_triples(spark, d):
    return triples.graph(triples.mapping_triples(_mappings(spark, d), Config())).select("s", "p", "o")


@_register("SELECT p, count(*) AS n FROM (SELECT 'https://schema.org/about' AS p, doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT 'https://schema.org/subjectOf', doc_id FROM labels WHERE toxic = 1) GROUP BY p")
def graph_union_predicate_counts(spark, d):
    m = triples.mapping_triples(_mappings(spark, d), Config())
    return triples.graph(m, m).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def geography(spark, d) -> DataFrame:
    """Nations, regions and customers as triples."""
    iri = lambda kind, c: F.concat(F.lit(f"http://g/{kind}/"), F.col(c).cast("string"))
    none, lit = F.lit(None).cast("string"), F.lit
    xsd = "http://www.w3.org/2001/XMLSchema#"

    def rows(df, s, p, o, kind="iri", dt=None):
        return df.select(s.alias("s"), lit("iri").alias("s_kind"), lit(f"http://g/{p}").alias("p"), o.cast("string").alias("o"), lit(kind).alias("o_kind"), (lit(dt) if dt else none).alias("o_datatype"), none.alias("o_lang"))

    n, r, c = (_t(spark, d, x) for x in ("nation", "region", "customer"))
    out = rows(n, iri("nation", "n_nationkey"), "in", iri("region", "n_regionkey")).union(rows(n, iri("nation", "n_nationkey"), "name", F.col("n_name"), "literal"))
    out = out.union(rows(r, iri("region", "r_regionkey"), "name", F.col("r_name"), "literal")).union(rows(c, iri("customer", "c_custkey"), "of", iri("nation", "c_nationkey")))
    out = out.union(rows(c, iri("customer", "c_custkey"), "segment", F.col("c_mktsegment"), "literal")).union(rows(c, iri("customer", "c_custkey"), "size", F.col("c_custkey") % 50, "literal", xsd + "integer"))
    return out.union(rows(c.where("c_custkey % 4 = 0"), iri("customer", "c_custkey"), "vip", lit("true"), "literal", xsd + "boolean"))


def _sparql(name: str, text: str, sql: str) -> None:
    _register(sql, name)(lambda spark, d: sparql(geography(spark, d), "PREFIX : <http://g/> " + text))


_C = "'http://g/customer/' || c_custkey"
_sparql("nation_region_path_bgp", "SELECT ?c ?region { ?c :of ?n . ?n :in ?r . ?r :name ?region }", f"SELECT {_C} AS c, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
_sparql("sparql_property_path", "SELECT ?c ?region { ?c :of/:in/:name ?region }", f"SELECT {_C} AS c, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
_sparql("sparql_select_distinct", "SELECT DISTINCT ?g { ?c :segment ?g }", "SELECT DISTINCT c_mktsegment AS g FROM customer")
_sparql("sparql_filter", 'SELECT ?c ?k { ?c :size ?k ; :segment ?g FILTER(?k >= 40 && ?g != "BUILDING") }', f"SELECT {_C} AS c, CAST(c_custkey % 50 AS VARCHAR) AS k FROM customer WHERE c_custkey % 50 >= 40 AND c_mktsegment <> 'BUILDING'")
_sparql("sparql_optional", "SELECT ?c ?v { ?c :of ?n OPTIONAL { ?c :vip ?v } }", f"SELECT {_C} AS c, CASE WHEN c_custkey % 4 = 0 THEN 'true' END AS v FROM customer")
_sparql("sparql_union", "SELECT ?x ?name { { ?x :in ?r ; :name ?name } UNION { ?n :in ?x . ?x :name ?name } }", "SELECT 'http://g/nation/' || n_nationkey AS x, n_name AS name FROM nation UNION ALL SELECT 'http://g/region/' || r_regionkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
_sparql("sparql_minus", "SELECT ?c { ?c :of ?n MINUS { ?c :vip true } }", f"SELECT {_C} AS c FROM customer WHERE c_custkey % 4 <> 0")
_sparql("sparql_exists", "SELECT ?c { ?c :of ?n FILTER EXISTS { ?c :size ?k FILTER(?k < 10) } FILTER NOT EXISTS { ?c :vip ?v } }", f"SELECT {_C} AS c FROM customer WHERE c_custkey % 50 < 10 AND c_custkey % 4 <> 0")
_sparql("sparql_group_having", "SELECT ?n (COUNT(?c) AS ?k) (SUM(?z) AS ?t) (MAX(?z) AS ?m) { ?c :of ?n ; :size ?z } GROUP BY ?n HAVING(COUNT(?c) > 3)", "SELECT 'http://g/nation/' || c_nationkey AS n, CAST(count(*) AS VARCHAR) AS k, CAST(sum(c_custkey % 50) AS VARCHAR) AS t, CAST(max(c_custkey % 50) AS VARCHAR) AS m FROM customer GROUP BY c_nationkey HAVING count(*) > 3")
_sparql("sparql_order_limit", "SELECT ?c ?k { ?c :size ?k } ORDER BY DESC(?k) ?c LIMIT 20 OFFSET 5", f"SELECT {_C} AS c, CAST(c_custkey % 50 AS VARCHAR) AS k FROM customer ORDER BY c_custkey % 50 DESC, {_C} LIMIT 20 OFFSET 5")
_sparql("sparql_values_bind", 'SELECT ?c ?g ?twice { VALUES ?g { "BUILDING" "MACHINERY" } ?c :segment ?g ; :size ?k BIND(?k * 2 AS ?twice) }', f"SELECT {_C} AS c, c_mktsegment AS g, CAST(c_custkey % 50 * 2 AS VARCHAR) AS twice FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_sparql("sparql_subselect", "SELECT ?c ?name { { SELECT ?n { ?n :in <http://g/region/1> } } ?c :of ?n . ?n :name ?name }", f"SELECT {_C} AS c, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
_sparql("sparql_ask", "ASK { ?c :vip true }", "SELECT count(*) > 0 AS answer FROM customer WHERE c_custkey % 4 = 0")
_sparql("sparql_construct", "CONSTRUCT { ?r :has ?c } WHERE { ?c :of/:in ?r }", f"SELECT 'http://g/region/' || n_regionkey AS s, 'iri' AS s_kind, 'http://g/has' AS p, {_C} AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang FROM customer JOIN nation ON n_nationkey = c_nationkey")


_sparql("sparql_aggregates", "SELECT ?g (AVG(?z) AS ?a) (MIN(?z) AS ?lo) (MAX(?z) AS ?hi) (SAMPLE(?g) AS ?x) (COUNT(DISTINCT ?z) AS ?d) { ?c :segment ?g ; :size ?z } GROUP BY ?g",
        "SELECT c_mktsegment AS g, CASE WHEN avg(z) = floor(avg(z)) THEN CAST(CAST(avg(z) AS BIGINT) AS VARCHAR) ELSE CAST(avg(z) AS VARCHAR) END AS a, CAST(min(z) AS VARCHAR) AS lo, CAST(max(z) AS VARCHAR) AS hi, c_mktsegment AS x, CAST(count(DISTINCT z) AS VARCHAR) AS d FROM (SELECT c_mktsegment, c_custkey % 50 AS z FROM customer) GROUP BY c_mktsegment")
_sparql("sparql_group_concat", 'SELECT ?r (GROUP_CONCAT(?name; SEPARATOR=", ") AS ?all) { ?n :in ?r ; :name ?name } GROUP BY ?r', "SELECT 'http://g/region/' || n_regionkey AS r, string_agg(n_name, ', ' ORDER BY n_name) AS all FROM nation GROUP BY n_regionkey".replace(" AS all ", ' AS "all" '))
_sparql("sparql_min_of_words", "SELECT (MIN(?name) AS ?lo) (MAX(?name) AS ?hi) (SUM(?k) AS ?t) { ?n :name ?name OPTIONAL { ?n :size ?k } }", "SELECT min(x) AS lo, max(x) AS hi, '0' AS t FROM (SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region)")
_sparql("sparql_path_inverse", "SELECT ?r ?n { ?r ^:in ?n }", "SELECT 'http://g/region/' || n_regionkey AS r, 'http://g/nation/' || n_nationkey AS n FROM nation")
_sparql("sparql_path_alternative", "SELECT ?c ?x { ?c :in|:of ?x }", f"SELECT 'http://g/nation/' || n_nationkey AS c, 'http://g/region/' || n_regionkey AS x FROM nation UNION ALL SELECT {_C}, 'http://g/nation/' || c_nationkey FROM customer")
_NODES = f"SELECT 'http://g/nation/' || n_nationkey AS x FROM nation UNION SELECT 'http://g/region/' || r_regionkey FROM region UNION SELECT 'http://g/region/' || n_regionkey FROM nation UNION SELECT {_C} FROM customer UNION SELECT 'http://g/nation/' || c_nationkey FROM customer"
_sparql("sparql_path_star", "SELECT ?x ?y { ?x (:of|:in)* ?y FILTER(isIRI(?x)) }", f"SELECT x, x AS y FROM ({_NODES}) UNION SELECT {_C}, 'http://g/nation/' || c_nationkey FROM customer UNION SELECT 'http://g/nation/' || n_nationkey, 'http://g/region/' || n_regionkey FROM nation UNION SELECT {_C}, 'http://g/region/' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
_sparql("sparql_path_maybe", "SELECT ?x ?y { ?x :in? ?y FILTER(isIRI(?x)) }", f"SELECT x, x AS y FROM ({_NODES}) UNION SELECT 'http://g/nation/' || n_nationkey, 'http://g/region/' || n_regionkey FROM nation")
_TRIPLE = "CAST(NULL AS VARCHAR) AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang"
_sparql("sparql_describe", "DESCRIBE <http://g/region/1>", f"SELECT 'http://g/region/1' AS s, 'iri' AS s_kind, 'http://g/name' AS p, r_name AS o, 'literal' AS o_kind, {_TRIPLE} FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'http://g/nation/' || n_nationkey, 'iri', 'http://g/in', 'http://g/region/1', 'iri', NULL, NULL FROM nation WHERE n_regionkey = 1")
_sparql("sparql_exists_in_or", "SELECT ?c { ?c :size ?k FILTER(?k > 45 || EXISTS { ?c :vip true } || (!EXISTS { ?c :of ?n } && ?k < 0)) }", f"SELECT {_C} AS c FROM customer WHERE c_custkey % 50 > 45 OR c_custkey % 4 = 0")
_sparql("sparql_optional_join", "SELECT ?c ?v ?d { ?c :of ?n OPTIONAL { ?c :vip ?v } { SELECT ?v ?d { VALUES (?v ?d) { (true 1) (false 2) } } } }", f"SELECT {_C} AS c, v, d FROM customer, (VALUES ('true', '1'), ('false', '2')) t(v, d) WHERE c_custkey % 4 <> 0 OR v = 'true'")
_sparql("sparql_optional_twice", "SELECT ?c ?v ?k { ?c :segment ?g OPTIONAL { ?c :vip ?v } OPTIONAL { ?c :size ?k . ?c :vip ?v } }", f"SELECT {_C} AS c, CASE WHEN c_custkey % 4 = 0 THEN 'true' END AS v, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 50 AS VARCHAR) END AS k FROM customer")
_sparql("sparql_minus_optional", "SELECT ?c { { ?c :of ?n OPTIONAL { ?c :vip ?v } } MINUS { VALUES ?v { true } } }", f"SELECT {_C} AS c FROM customer WHERE c_custkey % 4 <> 0")
_sparql("sparql_functions", 'SELECT ?c (HOURS(?t) AS ?h) (MINUTES(?t) AS ?m) (SECONDS(?t) AS ?s) (TZ(?t) AS ?z) (TIMEZONE(?t) AS ?o) { ?c :size 7 BIND("2024-05-06T07:08:09+05:30" AS ?t) }', f"SELECT {_C} AS c, '7' AS h, '8' AS m, '9' AS s, '+05:30' AS z, 'PT5H30M' AS o FROM customer WHERE c_custkey % 50 = 7")
_sparql("sparql_limit_only", "SELECT (COUNT(*) AS ?n) { { SELECT ?c { ?c :size ?k } LIMIT 10 } }", "SELECT CAST(least(count(*), 10) AS VARCHAR) AS n FROM customer")


@_register("SELECT page_id, url, CAST(row_number() OVER (ORDER BY url) AS BIGINT) AS place FROM (SELECT DISTINCT ON (url) page_id, url FROM pages ORDER BY url, page_id)")
def sorted_url_places(spark, d):
    """The sort of discovered URLs, with the place of each made visible."""
    from pyspark.sql import Window

    p = _t(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    # places by range: each range is numbered by itself, then shifted by what lies before it; ranges and
    # their numbers are written, since each use of the shuffle may merge its partitions in another way
    path = _shared(spark)
    p.repartitionByRange("url").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema("url string, page_id long, part int").parquet(path)
    within = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("url")))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return within.join(F.broadcast(before), "part").select("page_id", "url", (F.col("at") + F.col("before")).cast("long").alias("place"))


def _quads(spark, d) -> DataFrame:
    """The geography with a named graph for each predicate but names, which lie in the default graph."""
    last = F.regexp_extract("p", "([a-z]+)$", 1)
    return geography(spark, d).withColumn("g", F.when(last != "name", F.concat(F.lit("http://g/graph/"), last)))


@_register(f"SELECT {_C} AS c, 'http://g/nation/' || c_nationkey AS n FROM customer")
def sparql_graph_fixed(spark, d):
    return sparql(_quads(spark, d), "PREFIX : <http://g/> SELECT ?c ?n { GRAPH <http://g/graph/of> { ?c ?p ?n } }")


@_register(f"SELECT 'http://g/graph/in' AS g, 'http://g/region/' || n_regionkey AS x, 'http://g/nation/' || n_nationkey AS y FROM nation")
def sparql_graph_path(spark, d):
    """A path inside one graph: no edge of another graph goes on from it."""
    return sparql(_quads(spark, d), "PREFIX : <http://g/> SELECT ?g ?x ?y { GRAPH ?g { ?x ^:in/(:of|:in)? ?y . ?y :in ?x } }")


@_register(f"SELECT 'http://g/graph/of' AS g, {_C} AS x, 'http://g/nation/' || c_nationkey AS y FROM customer UNION SELECT 'http://g/graph/in', 'http://g/nation/' || n_nationkey, 'http://g/region/' || n_regionkey FROM nation")
def sparql_graph_closure(spark, d):
    return sparql(_quads(spark, d), "PREFIX : <http://g/> SELECT ?g ?x ?y { GRAPH ?g { ?x (:of|:in)+ ?y } }")


_sparql("sparql_reach_from", "SELECT ?y { <http://g/customer/7> (:of|:in)+ ?y }", "SELECT 'http://g/nation/' || c_nationkey AS y FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'http://g/region/' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7")
_sparql("sparql_reach_to", "SELECT ?x { ?x (:of|:in)+ <http://g/region/1> }", f"SELECT 'http://g/nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 1 UNION ALL SELECT {_C} FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
_BIG = "CAST(9007199254740992 AS HUGEINT)"
_POINT = "rtrim(rtrim(CAST({0} AS VARCHAR), '0'), '.')"
_sparql("sparql_exact_whole", "SELECT ?c ?x ?y { ?c :size ?k BIND(?k + 9007199254740992 AS ?x) BIND(?x * 9007199254740993 AS ?y) FILTER(?x != 9007199254740993 && ?y > 81129638414606699710187514626049) }", f"SELECT {_C} AS c, CAST({_BIG} + k AS VARCHAR) AS x, CAST(({_BIG} + k) * ({_BIG} + 1) AS VARCHAR) AS y FROM (SELECT c_custkey, c_custkey % 50 AS k FROM customer) WHERE k <> 1 AND k > 1")
_sparql("sparql_exact_decimal", "SELECT ?c ?x ?y ?z { ?c :size ?k BIND(?k * 0.1 + 0.2 AS ?x) BIND(?k / 8 AS ?y) BIND(ROUND(?k * 0.25) AS ?z) FILTER(?x > 0.3 && 0.1 + 0.2 = 0.3) }", f"SELECT {_C} AS c, {_POINT.format('CAST(k AS DECIMAL(9,1)) * 0.1 + 0.2')} AS x, {_POINT.format('CAST(k AS DECIMAL(9,3)) * 0.125')} AS y, CAST((k + 2) // 4 AS VARCHAR) AS z FROM (SELECT c_custkey, c_custkey % 50 AS k FROM customer) WHERE k > 1")
_sparql("sparql_exact_sums", "SELECT ?g (SUM(?x) AS ?s) (AVG(?w) AS ?a) (MAX(?y) AS ?m) { ?c :segment ?g ; :size ?k BIND(?k * 0.1 AS ?x) BIND(?k * 4 AS ?w) BIND(?k + 9007199254740992 AS ?y) } GROUP BY ?g", f"SELECT c_mktsegment AS g, {_POINT.format('CAST(sum(k) AS DECIMAL(18,1)) * 0.1')} AS s, regexp_replace(CAST(avg(k * 4) AS VARCHAR), '[.]0$', '') AS a, CAST({_BIG} + max(k) AS VARCHAR) AS m FROM (SELECT c_mktsegment, c_custkey % 50 AS k FROM customer) GROUP BY c_mktsegment")
_sparql("sparql_string_edges", 'SELECT ?n (SUBSTR(?n, 0, 3) AS ?a) (SUBSTR(?n, 2) AS ?b) (SUBSTR(?n, -1, 4) AS ?c) (STRBEFORE(?n, "") AS ?d) (STRAFTER(?n, "") AS ?e) (STRBEFORE(?n, "A") AS ?f) (STRAFTER(?n, "A") AS ?h) (LANG(CONCAT(STRLANG(?n, "en"), "x"@en)) AS ?i) (LANG(CONCAT(STRLANG(?n, "en"), "x")) AS ?j) { ?r :name ?n . ?r :in ?o }',
    "SELECT n_name AS n, n_name[1:2] AS a, n_name[2:] AS b, n_name[1:2] AS c, '' AS d, n_name AS e, CASE WHEN contains(n_name, 'A') THEN n_name[1 : strpos(n_name, 'A') - 1] ELSE '' END AS f, CASE WHEN contains(n_name, 'A') THEN n_name[strpos(n_name, 'A') + 1 :] ELSE '' END AS h, 'en' AS i, '' AS j FROM nation")


@_register("SELECT 'http://g/graph/in' AS g, CAST(count(*) AS VARCHAR) AS n FROM nation UNION ALL SELECT 'http://g/graph/of', CAST(count(*) AS VARCHAR) FROM customer UNION ALL SELECT 'http://g/graph/segment', CAST(count(*) AS VARCHAR) FROM customer UNION ALL SELECT 'http://g/graph/size', CAST(count(*) AS VARCHAR) FROM customer UNION ALL SELECT 'http://g/graph/vip', CAST(count(*) AS VARCHAR) FROM customer WHERE c_custkey % 4 = 0 HAVING count(*) > 0")
def sparql_graph_variable(spark, d):
    return sparql(_quads(spark, d), "PREFIX : <http://g/> SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


_quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
_TREE = ", ".join(f"({_quoted(i)}, {_quoted(label)}, {_quoted(up)})" for i, label, up in concepts.listed())
_EDGES = ", ".join(f"({_quoted(i)}, {_quoted(up)})" for i, _, up in concepts.listed() if up)
_ORD = "lpad(CAST(len(string_split(id, '_')) AS VARCHAR), 3, '0') || array_to_string(list_transform(string_split(id, '_'), lambda x: lpad(x, 10, '0')), '')"


@_register(f"SELECT id, '{_N}' || id AS url, label, p AS parent_id, {_ORD} AS ord FROM (VALUES {_TREE}) t(id, label, p)")
def taxonomy_star_bgp(spark, d):
    return classify.taxonomy(concepts.concept_triples(spark, _N))


@_register(SQL["taxonomy_star_bgp"])
def taxonomy_builtin(spark, d):
    return concepts.concepts(spark, _N)


@_register(f"WITH RECURSIVE e(c, p) AS (VALUES {_EDGES}), r AS (SELECT c, p FROM e UNION SELECT r.c, e.p FROM r JOIN e ON e.c = r.p) SELECT '{_N}' || c AS x, '{_N}' || p AS y FROM r")
def taxonomy_broader_closure(spark, d):
    return sparql(concepts.concept_triples(spark, _N), "PREFIX skos: <http://www.w3.org/2004/02/skos/core#> SELECT ?x ?y { ?x skos:broader+ ?y }")


@_register(f"SELECT p, count(*) AS n FROM (SELECT unnest(['type', 'inScheme', 'prefLabel']) AS p FROM (VALUES {_TREE}) t(id, label, up) UNION ALL SELECT unnest(CASE WHEN up IS NULL THEN ['topConceptOf', 'hasTopConcept'] ELSE ['broader', 'narrower'] END) FROM (VALUES {_TREE}) t(id, label, up) UNION ALL SELECT unnest(['type', 'prefLabel', 'definition'])) GROUP BY p")
def taxonomy_triple_counts(spark, d):
    found = triples.graph(concepts.concept_triples(spark, _N))
    return found.groupBy(F.regexp_extract("p", "([A-Za-z]+)$", 1).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@_register(f"SELECT CAST(len(string_split(id, '_')) AS BIGINT) AS depth, count(*) AS n FROM (VALUES {_TREE}) t(id, label, p) GROUP BY 1")
def taxonomy_tree_counts(spark, d):
    return taxonomy_star_bgp(spark, d).groupBy(F.size(F.split("id", "_")).cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents matched to labels, made triples, counted per predicate."""
    texts, labels = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    best = classify.best_match(texts, labels, "doc_id", "text", "item_id", "text", "item_id", 0.05)
    rows = _docs_as_articles(spark, d).drop("category")
    found = best.select(F.concat(F.lit("http://d/"), F.col("key").cast("string")).alias("_url"), "category")
    rows = rows.join(found, rows["url"] == found["_url"])
    return triples.graph(triples.article_triples(rows, Config())).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
