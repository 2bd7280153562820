from datetime import datetime

import pytest

from claimloom.config import XSD, Config
from claimloom.operators import classify, ingest, stats, triples
from claimloom.plans import sparql
from claimloom.plans.sparql import query
from claimloom.schemas import ARTICLES, CLAIMS, MAPPINGS, TRIPLES
from claimloom.serve import answer
from claimloom.sources import rdf, web

TTL = """@prefix : <http://x/> . # comment
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :p :b ; :n 3 ; :l "hi \\"q\\""@en , "multi\\nline" . :b :p :c ; :n 5 . :c :p :a ; :l "yo"^^xsd:string . :d :q :a, :b ; :n 2.5 ."""
P = "PREFIX : <http://x/> "


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(rdf.parse_turtle(TTL), TRIPLES)


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("SELECT ?s ?n { ?s :p ?o OPTIONAL { ?s :n ?n FILTER(?n > 3) } }", {("a", None), ("b", "5"), ("c", None)}),
        ("SELECT ?x { :a :p+ ?x }", {("b",), ("c",), ("a",)}),
        ("SELECT ?x { ?x :p* :a }", {("b",), ("c",), ("a",)}),
        ("SELECT ?x { :a :p? ?x }", {("a",), ("b",)}),
        ("SELECT ?x { ?x ^:p :a }", {("b",)}),
        ("SELECT ?x { :d :q/:p ?x }", {("b",), ("c",)}),
        ("SELECT ?x { :a !(:p|:l) ?x }", {("3",)}),
        ("SELECT ?s { ?s :p ?o MINUS { ?s :n ?n } }", {("c",)}),
        ("SELECT ?s { ?s :p ?o MINUS { ?y :n ?n } }", {("a",), ("b",), ("c",)}),
        ("SELECT ?s { ?s :p ?o FILTER NOT EXISTS { ?s :n ?m FILTER(?m < 4) } }", {("b",), ("c",)}),
        ("SELECT ?s { ?s :l 'yo' }", {("c",)}),
        ("SELECT ?s { ?s :n ?n FILTER(?n IN (3, 2.5)) }", {("a",), ("d",)}),
        ("SELECT ?s { ?s :l ?l FILTER(LANGMATCHES(LANG(?l), '*')) }", {("a",)}),
        ("SELECT ?s ?v { ?s :p ?o OPTIONAL { ?s :n ?n } OPTIONAL { ?n2 :n ?n . BIND(?n2 AS ?v) } FILTER(?s = :c) }", None),
        ("SELECT (COUNT(*) AS ?c) (SUM(?n) AS ?t) { ?s :n ?n }", {("3", "10.5")}),
        ("SELECT ?s ?y { VALUES (?s ?y) { (:a UNDEF) (UNDEF 'k') } ?s :p ?o }", {("a", None), ("a", "k"), ("b", "k"), ("c", "k")}),
        ("SELECT ?s { GRAPH ?g { ?s :p ?o } }", set()),
    ],
)
def test_sparql(graph, text, rows):
    got = {tuple(v.removeprefix("http://x/") if v else v for v in r) for r in query(graph, P + text).collect()}
    assert rows is None or got == rows


def test_sparql_rejects(graph):
    for text in ("SELECT * { SERVICE <http://e> { ?s ?p ?o } }", "DELETE WHERE { ?s ?p ?o }", "SELECT ?s { ?s nope:x ?o }", "SELECT ?s { ?s"):
        with pytest.raises(ValueError):
            query(graph, text)
    kind, body = answer(graph, P + "SELECT ?s ?l { ?s :l ?l FILTER(LANG(?l) = 'en') }", {})
    assert kind.endswith("results+json") and '"xml:lang": "en"' in body


def test_rdf_round_trips(spark, graph, tmp_path):
    rdf.write_ntriples(graph, str(tmp_path / "nt"))
    assert sorted(map(str, rdf.read_ntriples(spark, str(tmp_path / "nt")).collect())) == sorted(map(str, graph.collect()))
    rdf.write_turtle(graph, str(tmp_path / "ttl"), {"x": "http://x/"})
    assert sorted(map(str, rdf.read_turtle(spark, str(tmp_path / "ttl")).collect())) == sorted(map(str, graph.collect()))
    invented = """@prefix : <http://t/#> . @prefix s: <http://s/> . # a taxonomy in small
:S a s:Scheme ; s:top :0, :1 . :0 a s:Concept ; s:label "none of \\"them\\""@en . :1 a s:Concept ; s:label 'one'@en, "eins"@de ; s:narrower :1_1 ; s:order 1.5, -2, 1e3 .
:1_1 a s:Concept ; s:broader :1 ; s:note \"\"\"two
lines\"\"\" ; s:list ( :0 "x" ) ; s:see [ s:at <http://e/> ] ."""
    assert len(set(rdf.parse_turtle(invented))) == 22


def _article(**given):
    base = {"url": "http://e/a", "main_url": "http://e/a", "lang": "en", "title": "T", "category_state": "set"}
    return base | given


def test_article_triples(spark):
    level = [{"level": "basic", "urls": ["x"]}]
    rows = [
        _article(level="basic", levels=level, category="1_1", keywords=["k1", "k2"], related_arguments=[{"url": "http://e/b", "title": "B"}], author="A B"),
        _article(url="http://e/x", level="advanced", levels=level),
        _article(url="http://e/t", lang=None),
        _article(url="http://e/de", lang="de", category="0_0", level="advanced", levels=level),
    ]
    df = spark.createDataFrame(rows, ARTICLES)
    found = triples.graph(triples.article_triples(df, Config()))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    about = {(r[0], r[3]) for r in got if r[2].endswith("/about")}
    assert about == {(o, s) for s, o in {(r[0], r[3]) for r in got if r[2].endswith("/subjectOf")}} and len(about) == 1
    assert len({r[0] for r in got if r[1] == "bnode"}) == 2
    assert {r[3] for r in got if r[2].endswith("/keywords")} == {"k1", "k2"}
    assert sum(r[2].endswith("sameAs") for r in got) == 1 and not any(r[3] is None for r in got)
    assert triples.tombstones(df) == 1 and triples.article_triples(df.limit(0), Config()).count() == 0


def test_ingest(spark):
    claims = spark.createDataFrame([("u1", "2020", " "), ("u1", "2019", "the cat and the dog"), ("u1", "2018", "old"), ("u2", "2020", "x"), (None, "1", "y")], CLAIMS)
    stored = spark.createDataFrame([("u2", None, "c", "en", None, "absent")], MAPPINGS)
    new = ingest.new_mappings(claims, stored).collect()
    assert [(r["url"], r["claim"], r["lang"]) for r in new] == [("u1", "the cat and the dog", "en")]
    old = spark.createDataFrame([("a", "c1", "set", "t"), ("b", None, "absent", "t")], "url string, category string, category_state string, title string")
    inc = spark.createDataFrame([("a", "n"), ("c", "n")], "url string, title string")
    once = ingest.upsert(old, inc, "url")
    assert {tuple(r) for r in once.collect()} == {("a", "c1", "set", "n"), ("b", None, "absent", "t"), ("c", None, "absent", "n")}
    assert {tuple(r) for r in ingest.upsert(once, inc, "url").collect()} == {tuple(r) for r in once.collect()}
    counts = stats.value_counts(old, "category")
    assert stats.summary(counts).first()[:] == (2, 2, 1)


def test_matching_plans_agree(spark):
    texts = spark.createDataFrame([(1, "warm sea water"), (2, ""), (3, None), (4, "cold ice sea")], "k int, t string")
    labels = spark.createDataFrame([(0, "sea water"), (1, "water sea"), (2, "")], "i int, l string")
    args = (texts, labels, "k", "t", "i", "l", "i")
    cross = {(r["key"], r["label_id"]): r["similarity"] for r in classify.all_scores(*args).collect()}
    assert {k: v for k, v in cross.items() if v > 0} == {(r["key"], r["label_id"]): r["similarity"] for r in classify.scores(*args).collect()}
    best = {r["key"]: (r["category"], round(r["similarity"], 3)) for r in classify.best_match(*args).collect()}
    assert best[1] == ("0", 0.667) and best[2] == ("0", 0.0) and best[4] == ("0", 0.25)


def test_two_stage(spark):
    texts = spark.createDataFrame([("yes a",), ("no",), (None,)], "t string")
    load_binary = lambda: lambda xs: [[0.0, 1.0] if x.startswith("yes") else [1.0, 0.0] for x in xs]
    load_classes = lambda: lambda xs: [[0.0] * 17 + [1.0] for _ in xs]
    assert [r["category"] for r in classify.two_stage(texts, "t", load_binary, load_classes).collect()] == ["5_3", "0", None]


def test_pages_and_cache(spark):
    now = datetime(2024, 1, 1, 12)
    urls = spark.createDataFrame([("u1",), ("u2",)], "url string")
    import hashlib

    cache = spark.createDataFrame([(hashlib.md5(b"u1").hexdigest(), "cached", datetime(2024, 1, 1, 11, 30))], "url_hash string, content string, fetched_at timestamp")
    got, new = web.pages(urls, cache, now, 3600, get=lambda u: (200, f"page {u}"))
    assert {tuple(r) for r in got.collect()} == {("u1", "cached"), ("u2", "page u2")} and new.count() == 1
    assert web.pages(urls, cache, now, 60, get=lambda u: (500, ""), strict=False)[0].count() == 0
    assert web.binding_rows('{"results": {"bindings": [{"a": {"value": "1"}}]}}', ["a", "b"]) == [("1", None)] and web.binding_rows("<html>", ["a"]) == []


def test_cli_end_to_end(spark, tmp_path, capsys, monkeypatch):
    from claimloom.cli import main

    spark.createDataFrame([("http://e/a.htm", "<title>Sea water</title>")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "claims.json").write_text('{"rev": "http://r/1", "date_published": "2020", "text": "label one of the sea"}')
    (tmp_path / "t.ttl").write_text('@prefix s: <http://www.w3.org/2004/02/skos/core#> . <http://e/#1_1> a s:Concept ; s:inScheme <http://e/#S> ; s:prefLabel "label one"@en .')
    db = ["--articles-db", str(tmp_path / "a"), "--mappings-db", str(tmp_path / "m")]
    for _ in range(2):
        assert main(["process", str(tmp_path / "pages"), "--claims", str(tmp_path / "claims.json"), "--taxonomy", str(tmp_path / "t.ttl"), *db], spark) == 0
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    assert main(["build", "--taxonomy", str(tmp_path / "t.ttl"), "--output", str(tmp_path / "g"), *db], spark) == 0
    assert main(["query", "--rdf", str(tmp_path / "g"), "SELECT ?c { ?c sdo:about ?x }"], spark) == 0
    assert "http://r/1" in capsys.readouterr().out


def test_streamed_claims(spark, tmp_path):
    from claimloom.streaming.incremental import stream_claims

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"rev": "u", "date_published": "2020", "text": "x"}\n{"rev": "u", "date_published": "2021", "text": "y"}')
    store = str(tmp_path / "store")
    spark.createDataFrame([], MAPPINGS).write.parquet(store)
    claims = spark.readStream.schema(CLAIMS).json(str(tmp_path / "in"))
    q = stream_claims(claims, lambda: spark.read.schema(MAPPINGS).parquet(store), lambda df: df.write.mode("append").parquet(store), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["claim"] for r in spark.read.parquet(store).collect()] == ["y"]


def test_sql_function_of_the_matcher(spark):
    from claimloom.operators import concepts

    classify.register_classify(spark, concepts.concepts(spark, "n#"), name="category_of")
    spark.createDataFrame([(1, "ice isn't melting"), (2, "zzz"), (3, None), (4, "the polar bears")], "i int, t string").createOrReplaceTempView("claims_to_match")
    got = {r["i"]: r["c"] for r in spark.sql("SELECT i, category_of(t) AS c FROM claims_to_match").collect()}
    rows = spark.table("claims_to_match")
    best = classify.best_match(rows, concepts.concepts(spark, "n#"), "i", "t", "id", "label", "ord")
    assert got == {r["key"]: r["category"] for r in best.collect()} == {1: "1_1", 2: "0", 3: "0", 4: "3_2_2"}


def test_numbers_keep_every_digit(spark):
    """Whole numbers past 2**53, decimals, quotients and what leaves them."""
    one = spark.createDataFrame([("http://e/a", "iri", "http://e/n", v, "literal", XSD + t, None) for v, t in (("9007199254740992", "integer"), ("9007199254740993", "integer"), ("0.1", "decimal"), ("1e0", "double"))], TRIPLES)
    ask = lambda text: sorted(tuple(r) for r in sparql.query(one, text).collect())
    assert ask("SELECT ?o { ?s ?p ?o FILTER(?o = 9007199254740993) }") == [("9007199254740993",)]
    assert ask("SELECT ?o { ?s ?p ?o } ORDER BY DESC(?o) LIMIT 1") == [("9007199254740993",)]
    assert ask("SELECT (MAX(?o) AS ?m) (SUM(?o) AS ?t) { ?s ?p ?o FILTER(?o > 2) }") == [("9007199254740993", "18014398509481985")]
    shown = "SELECT (0.1 + 0.2 AS ?a) (DATATYPE(0.1 + 0.2) AS ?b) (1 / 8 AS ?c) (1 / 3 AS ?d) (DATATYPE(1 / 3) AS ?e) (-3 * 7 AS ?f) (1 / 0 AS ?g) (ROUND(2.5) AS ?h) (ROUND(-2.5) AS ?i) (ABS(-0.50) AS ?j) (CEIL(1.2) AS ?k) (1e0 + 1 AS ?l) (<http://www.w3.org/2001/XMLSchema#integer>(\"-7.9\") AS ?m) (<http://www.w3.org/2001/XMLSchema#decimal>(\"2.50\") AS ?n) { }"
    assert ask(shown) == [("0.3", XSD + "decimal", "0.125", "0.3333333333333333", XSD + "double", "-21", None, "3", "-2", "0.5", "2", "2.0", "-7", "2.5")]
    chain = "SELECT ?z { BIND(1 AS ?a) " + " ".join(f"BIND(?{x} + ?{x} AS ?{y})" for x, y in zip("abcde", "bcdez", strict=True)) + " FILTER(?z > 30) }"
    assert ask(chain) == [("32",)]  # each step names the one before twice


def test_search_from_bound_ends(spark):
    """Only what a bound end reaches is looked at: a long chain apart from it costs no round."""
    edges = [("a", "b"), ("b", "c"), ("c", "a")] + [(f"x{i}", f"x{i + 1}") for i in range(30)]
    g = spark.createDataFrame([(f"http://e/{s}", "iri", "http://e/p", f"http://e/{o}", "iri", None, None) for s, o in edges], TRIPLES)
    counted = []
    real = sparql.Compiler._chained
    try:
        sparql.Compiler._chained = staticmethod(lambda a, b: counted.append(1) or real(a, b))
        assert {r[0] for r in sparql.query(g, "SELECT ?y { <http://e/a> <http://e/p>+ ?y }").collect()} == {f"http://e/{x}" for x in "abc"}
        forward = len(counted)
        assert {r[0] for r in sparql.query(g, "SELECT ?x { ?x <http://e/p>+ <http://e/c> }").collect()} == {f"http://e/{x}" for x in "abc"}
        assert forward <= 4 and len(counted) - forward <= 4
        assert {r[0] for r in sparql.query(g, "SELECT ?y { <http://e/x28> <http://e/p>* ?y }").collect()} == {"http://e/x28", "http://e/x29", "http://e/x30"}
        assert sparql.query(g, "ASK { <http://e/a> <http://e/p>+ <http://e/x3> }").first()[0] is False
    finally:
        sparql.Compiler._chained = staticmethod(real)
