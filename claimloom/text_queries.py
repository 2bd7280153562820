"""Registered queries of what is learnt from texts: lexicon, languages, models, matching under a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import classify, concepts, language, lexicon, scorer
from .plans.sparql import query as sparql
from .page_queries import _shared
from .queries import _register, _t

_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\pL]+')"
_LEXICON = f"""WITH voc AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word),
cuts AS (SELECT word, word[1 : len(word) - k] AS stem, CASE WHEN k = 0 THEN '' ELSE word[len(word) - k + 1 :] END AS ending FROM voc, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE len(word) - k >= 3),
pairs AS (SELECT f.ending, b.ending AS base_ending, count(*) AS stems FROM cuts f JOIN cuts b USING (stem) WHERE len(f.ending) >= 1 AND len(b.ending) <= 1 AND len(f.ending) > len(b.ending) GROUP BY ALL HAVING count(*) >= 5),
every AS (SELECT ending, count(*) AS whole FROM cuts WHERE ending <> '' GROUP BY ending),
edits AS (SELECT ending, base_ending, stems FROM pairs JOIN every USING (ending) WHERE stems >= 0.3 * whole),
lem AS (SELECT word, arg_min(base, ord) AS lemma FROM (SELECT c.word, c.stem || e.base_ending AS base, {{'a': -len(c.ending), 'b': -e.stems, 'c': len(e.base_ending), 'd': e.base_ending}} AS ord
  FROM cuts c JOIN edits e USING (ending) WHERE c.ending <> '') JOIN voc v ON v.word = base GROUP BY ALL)"""
_LEXICON = _LEXICON.replace("FROM cuts c JOIN edits e USING (ending) WHERE c.ending <> '') JOIN voc v ON v.word = base GROUP BY ALL)", "FROM cuts c JOIN edits e USING (ending) WHERE c.ending <> '') x JOIN voc v ON v.word = x.base GROUP BY x.word)").replace("SELECT word, arg_min(base, ord)", "SELECT x.word, arg_min(base, ord)")
_INSIDE = """, tok AS (SELECT string_split(coalesce(text, ''), ' ') AS t FROM documents),
nbr AS (SELECT unnest(t[1 : len(t) - 1]) AS before, unnest(t[2 :]) AS cur FROM tok WHERE len(t) > 1),
mid AS (SELECT regexp_extract(cur, '^[\\pL]+') AS w FROM nbr WHERE regexp_matches(before, '[\\pL,;]$')),
prop AS (SELECT lower(w) AS word, count(*) FILTER (WHERE w[1] <> lower(w[1]) AND w[2 :] = lower(w[2 :])) AS n_capital, count(*) FILTER (WHERE w = lower(w)) AS n_small FROM mid WHERE w <> '' GROUP BY lower(w)
  HAVING n_capital >= 3 AND n_capital >= 0.8 * (n_capital + n_small))"""
_NONE = "[" + ", ".join(f"'{w}'" for w in (*T.STOP_WORDS, *lexicon.NUMBER_WORDS)) + "]"


def _cleaned(name: str, table: str, key: str) -> str:
    words = f"SELECT {key} AS key, unnest(list_filter(list_distinct({_WORDS}), lambda w: NOT list_contains({_NONE}, w))) AS word FROM {table}"
    rows = f"SELECT DISTINCT key, coalesce(lemma, word) AS token FROM ({words}) LEFT JOIN lem USING (word) WHERE word NOT IN (SELECT word FROM prop)"
    return f", {name} AS (SELECT {key} AS key, coalesce(tokens, []) AS tokens FROM {table} LEFT JOIN (SELECT key, list(token ORDER BY token) AS tokens FROM ({rows}) GROUP BY key) c ON c.key = {key})"


def _learnt(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, d, "documents")
    words = lexicon.vocabulary(docs, "text")
    return lexicon.lemmas(words, lexicon.suffix_edits(words)), lexicon.proper_nouns(docs, "text")


def _kept(spark, d) -> tuple[DataFrame, DataFrame]:
    """The same, written: the words are counted once and the tables read as often as they are used."""
    docs, path = _t(spark, d, "documents"), _shared(spark)
    lexicon.vocabulary(docs, "text").write.parquet(f"{path}/words")
    words = spark.read.schema("word string, n long").parquet(f"{path}/words")
    lexicon.lemmas(words, lexicon.suffix_edits(words)).write.parquet(f"{path}/lemmas")
    lexicon.proper_nouns(docs, "text").write.parquet(f"{path}/names")
    return spark.read.schema("word string, lemma string").parquet(f"{path}/lemmas"), spark.read.schema("word string, n_capital long, n_small long").parquet(f"{path}/names")


@_register(_LEXICON + " SELECT ending, base_ending, stems FROM edits")
def lexicon_edits(spark, d):
    """Suffix edits that the word families of all documents show."""
    return lexicon.suffix_edits(lexicon.vocabulary(_t(spark, d, "documents"), "text"))


@_register(_LEXICON + " SELECT word, lemma FROM lem")
def lexicon_lemmas(spark, d):
    return _learnt(spark, d)[0]


@_register("WITH z AS (SELECT 1)" + _INSIDE + " SELECT word, n_capital, n_small FROM prop")
def lexicon_proper_nouns(spark, d):
    return _learnt(spark, d)[1]


@_register(_LEXICON + _INSIDE + _cleaned("c", "documents", "doc_id") + " SELECT key AS doc_id, CAST(len(tokens) AS INTEGER) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM c")
def doc_clean_lemmas(spark, d):
    """Base forms of whole texts without stop words, number words and names."""
    cleaned = lexicon.clean_texts(_t(spark, d, "documents"), "doc_id", "text", *_learnt(spark, d))
    return cleaned.select(F.col("key").alias("doc_id"), F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


_BEST = """, p AS (SELECT l.key AS doc_id, r.key AS item_id, len(list_intersect(l.tokens, r.tokens)) AS k, len(l.tokens) AS n, len(r.tokens) AS m FROM c l, b r),
s AS (SELECT doc_id, item_id, CASE WHEN n + m - k = 0 THEN 0.0::DOUBLE ELSE k::DOUBLE / (n + m - k)::DOUBLE END AS similarity FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id) AS r FROM s)
SELECT doc_id AS key, CASE WHEN similarity >= 0.1 AND similarity > 0 THEN CAST(item_id AS VARCHAR) ELSE '0' END AS category, similarity FROM o WHERE r = 1"""


@_register(_LEXICON + _INSIDE + _cleaned("c", "documents", "doc_id") + _cleaned("b", "benchmark", "item_id") + _BEST)
def lemma_best_match(spark, d):
    """The most similar label by base forms; jaccard_best_match is the same by plain words."""
    learnt = _kept(spark, d)
    docs, labels = (lexicon.clean_texts(_t(spark, d, table), key, "text", *learnt) for table, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    return classify.best_match(docs, labels, "key", "tokens", "key", "tokens", "key", 0.1, tokens=lambda c: c)


_GRAMS = """SELECT {key} AS key{more}, unnest(list_transform(range(1, len(word) + 1), lambda i: (' ' || word || ' ')[i : i + 2])) AS gram
FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\pL]+')) AS word FROM documents)"""
_PROFILES = "WITH tr AS (" + _GRAMS.format(key="doc_id", more=", lang") + " WHERE lang IS NOT NULL AND doc_id % 4 <> 2), cnt AS (SELECT lang, gram, count(*) AS n FROM tr GROUP BY ALL), prof AS (SELECT lang, gram, CAST(401 - row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS BIGINT) AS weight FROM cnt QUALIFY weight >= 1)"
_DETECTED = _PROFILES + ", g AS (SELECT DISTINCT key, gram FROM (" + _GRAMS.format(key="doc_id", more="") + ")), v AS (SELECT key, prof.lang, sum(weight) AS score FROM g JOIN prof USING (gram) GROUP BY ALL), det AS (SELECT key, arg_min(lang, {'a': -score, 'b': lang}) AS detected FROM v GROUP BY key)"


def _detected(spark, d, which: str = "TRUE") -> DataFrame:
    docs = _t(spark, d, "documents")
    return language.languages(docs.where(which), "doc_id", "text", language.profiles(docs.where("doc_id % 4 <> 2"), "text", "lang"))


@_register(_PROFILES + " SELECT lang, gram, weight FROM prof")
def language_profiles(spark, d):
    """Trigram profiles of every language; a quarter of the documents is held out for language_accuracy."""
    return language.profiles(_t(spark, d, "documents").where("doc_id % 4 <> 2"), "text", "lang")


@_register(_DETECTED + " SELECT doc_id AS key, detected FROM documents LEFT JOIN det ON det.key = doc_id")
def doc_language_ngrams(spark, d):
    return _detected(spark, d)


@_register(_DETECTED + " SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE detected = lang) AS BIGINT) AS n_right FROM documents LEFT JOIN det ON det.key = doc_id WHERE doc_id % 4 = 2 GROUP BY lang")
def language_accuracy(spark, d):
    """How many held-out documents get their language."""
    held = _t(spark, d, "documents").where("doc_id % 4 = 2").select("doc_id", "lang")
    found = _detected(spark, d, "doc_id % 4 = 2").withColumnRenamed("key", "doc_id")
    return held.join(found, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("detected") == F.col("lang")).alias("n_right"))


_HELD = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0"


def _staged(spark, d) -> DataFrame:
    """doc_id, quality, lang, category: a first model that passes texts of quality, a second that tells languages; a fifth is held out."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared(spark))
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    learn = docs.where(f"NOT {_HELD} AND quality IS NOT NULL")
    tongues = tuple(r["lang"] for r in learn.select("lang").where("lang IS NOT NULL").distinct().orderBy("lang").collect())  # the classes
    path = _shared(spark)
    for label, classes in (("quality", ("0", "1")), ("lang", tongues)):
        scorer.fit(learn, "text", label, classes, rounds=12).save(spark, f"{path}/{label}")
    binary, second = (scorer.load(spark, f"{path}/{label}").loader(spark) for label in ("quality", "lang"))
    return classify.two_stage(docs, "text", binary, second, size=None, names=tongues)


@_register()
def two_stage_trained(spark, d):
    """Every document through both models, learnt, saved and loaded: its language, or 0 without quality."""
    return _staged(spark, d).select("doc_id", "category")


@_register()
def two_stage_accuracy(spark, d):
    """By true category of held-out labelled documents: how many there are and how many get it."""
    held = _staged(spark, d).where(f"{_HELD} AND quality IS NOT NULL")
    true = F.when(F.col("quality") == 0, "0").otherwise(F.col("lang")).alias("truth")
    return held.select(true, "category").groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("category") == F.col("truth")).alias("n_right"))


_PLACES = """WITH t AS (SELECT CAST(r_regionkey + 1 AS VARCHAR) AS id, r_name AS label, CAST(NULL AS VARCHAR) AS parent_id FROM region
UNION ALL SELECT (n_regionkey + 1) || '_' || (n_nationkey + 1), n_name, CAST(n_regionkey + 1 AS VARCHAR) FROM nation
UNION ALL SELECT (n_regionkey + 1) || '_' || (n_nationkey + 1) || '_' || s_suppkey, s_name, (n_regionkey + 1) || '_' || (n_nationkey + 1) FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def _places(spark, d) -> DataFrame:
    """A taxonomy of suppliers under nations under regions, as a SKOS graph."""
    for name in ("region", "nation", "supplier"):
        _t(spark, d, name).createOrReplaceTempView(f"places_{name}")
    text = _PLACES.replace("VARCHAR", "STRING")
    for name in ("region", "nation", "supplier"):
        text = text.replace(f"FROM {name}", f"FROM places_{name}").replace(f"JOIN {name}", f"JOIN places_{name}")
    return concepts.skos_graph(spark.sql(text + " SELECT * FROM t"), "http://p/#", title="Places")


@_register(_PLACES + " SELECT id, 'http://p/#' || id AS url, label, parent_id, lpad(CAST(len(string_split(id, '_')) AS VARCHAR), 3, '0') || array_to_string(list_transform(string_split(id, '_'), lambda x: lpad(x, 10, '0')), '') AS ord FROM t")
def places_taxonomy(spark, d):
    """Concepts read from a graph in one grouped pass."""
    return classify.taxonomy(_places(spark, d))


@_register(_PLACES + " SELECT 'http://p/#' || id AS x, 'http://p/#' || parent_id AS y FROM t WHERE parent_id IS NOT NULL UNION SELECT 'http://p/#' || a.id, 'http://p/#' || b.parent_id FROM t a JOIN t b ON b.id = a.parent_id WHERE b.parent_id IS NOT NULL")
def places_broader_closure(spark, d):
    return sparql(_places(spark, d), "PREFIX skos: <http://www.w3.org/2004/02/skos/core#> SELECT ?x ?y { ?x skos:broader+ ?y }")


@_register(_PLACES + " SELECT p, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(['type', 'inScheme', 'prefLabel'] || CASE WHEN parent_id IS NULL THEN ['topConceptOf', 'hasTopConcept'] ELSE ['broader', 'narrower'] END) AS p FROM t UNION ALL SELECT unnest(['type', 'prefLabel'])) GROUP BY p")
def places_triple_counts(spark, d):
    return _places(spark, d).groupBy(F.regexp_extract("p", "([A-Za-z]+)$", 1).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@_register(_PLACES + " SELECT a.label AS label, CAST(count(b.id) AS VARCHAR) AS n FROM t a LEFT JOIN t b ON b.parent_id = a.id GROUP BY a.id, a.label")
def places_children(spark, d):
    """Narrower concepts of every concept, by SPARQL."""
    found = sparql(_places(spark, d), "PREFIX skos: <http://www.w3.org/2004/02/skos/core#> SELECT ?c ?label (COUNT(?x) AS ?n) { ?c a skos:Concept ; skos:prefLabel ?label OPTIONAL { ?c skos:narrower ?x } } GROUP BY ?c ?label")
    return found.select("label", "n")
