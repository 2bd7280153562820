"""Findings of the third review: one test for each."""

import numpy as np
import pyarrow as pa
import pytest

from claimloom import page_queries, queries, text_queries
from claimloom.operators import classify, language, scorer
from claimloom.plans.sparql import query
from claimloom.schemas import TRIPLES
from claimloom.sources import rdf


def test_all_pairs_without_a_row_for_each_comparison(spark):
    """labels are compared through an index in arrays, some pairs at a time, not by a nested loop join."""
    texts = spark.createDataFrame([(k, " ".join(f"zq{chr(97 + (k * j) % 23)}" for j in range(k % 9))) for k in range(60)] + [(None, None)], "k int, t string")
    labels = spark.createDataFrame([(f"n{i}", " ".join(f"zq{chr(97 + (i * j) % 23)}" for j in range(i % 7)), -i) for i in range(40)], "i string, l string, o int")
    old, classify.PAIRS_AT_ONCE = classify.PAIRS_AT_ONCE, 90
    try:
        found = classify.all_scores(texts, labels, "k", "t", "i", "l", "o")
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
        rows = found.collect()
    finally:
        classify.PAIRS_AT_ONCE = old
    words = lambda x: set((x or "").split())
    want = {(t["k"], r["i"], r["o"], len(words(t["t"]) & words(r["l"])) / max(1, len(words(t["t"]) | words(r["l"])))) for t in texts.collect() for r in labels.collect()}
    assert len(rows) == 61 * 40 and {tuple(r) for r in rows} == want


def test_pages_that_share_a_url_through_the_cache(spark, tmp_path):
    """one row per page, fresh or asked for, though the URL is the same."""
    pages = [(1, "http://x/ab"), (2, "http://x/ab"), (3, "http://x/ab"), (5, "http://x/abcde"), (6, "http://x/abcde")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in page_queries.crawl_cached(spark, str(tmp_path)).collect())
    assert got == sorted((u, f"kept {u}" if i % 3 == 0 else f"page {u}") for i, u in pages if i % 3 == 0 or len(u) % 7)


def test_places_of_urls_when_partitions_merge(spark, tmp_path):
    """the numbers of ranges are the same wherever they are used."""
    spark.range(30_000).selectExpr("id AS page_id", "concat('http://x/', md5(cast(id AS string))) AS url").write.parquet(f"{tmp_path}/pages.parquet")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "20k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = queries.sorted_url_places(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    rows.sort(key=lambda r: r["url"])
    assert [r["place"] for r in rows] == list(range(1, 30_001))


@pytest.mark.parametrize("form", ["xml", "ttl", "json-ld"])
def test_large_graphs_in_several_files(spark, tmp_path, form):
    """files stay small, none is one task's whole work, and blank nodes are the same in all of them."""
    rows = [(f"http://x/s{k}", "iri", "http://x/p", f"_:n{k % 3}", "bnode", None, None) for k in range(300)]
    rows += [("_:n0", "bnode", "http://x/q", f"v{k}", "literal", None, None) for k in range(5)]
    old, rdf.FILE_BYTES = rdf.FILE_BYTES, 2000
    try:
        rdf.write_rdf(spark.createDataFrame(rows, TRIPLES), str(tmp_path / "g"), form, {"x": "http://x/"})
    finally:
        rdf.FILE_BYTES = old
    sizes = [f.stat().st_size for f in (tmp_path / "g").rglob("part-*")]
    assert len(sizes) > 3 and max(sizes) < 0.6 * sum(sizes)
    got = rdf.read_rdf(spark, str(tmp_path / "g"), form).collect()
    name = {r["o"]: r["s"] for r in got if r["s_kind"] == "iri"}
    assert len(got) == 305 and len(name) == 3 and len({r["s"] for r in got if r["s_kind"] == "bnode"} & set(name)) == 1


def test_features_some_rows_at_a_time():
    """F6, F8: a batch of many texts is not turned into features at once, and gradients add up to the same."""
    batch = pa.RecordBatch.from_arrays([pa.array([k % 2 for k in range(500)], pa.int32()), pa.array([f"word{k % 7} other{k % 3}" for k in range(500)])], ["y", "text"])
    made = list(scorer._featured(6)(iter([batch])))
    assert sum(b.num_rows for b in made) == 500 and max(b.num_rows for b in made) <= 200
    sums = [next(scorer._gradient(np.zeros((2, 64)), np.ones(2))(iter(x))) for x in (made, [pa.Table.from_batches(made).combine_chunks().to_batches()[0]])]
    assert np.allclose(sums[0].column(2).to_numpy(), sums[1].column(2).to_numpy())


def test_languages_of_held_out_documents_alone(spark, tmp_path, monkeypatch):
    """what is not counted is not detected."""
    rows = [(k, ("the sea is warm", "das meer ist warm")[k % 3 == 0], ("en", "de")[k % 3 == 0]) for k in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, real = [], language.languages
    monkeypatch.setattr(language, "languages", lambda texts, *a: seen.append(texts) or real(texts, *a))
    got = {tuple(r) for r in text_queries.language_accuracy(spark, str(tmp_path)).collect()}
    assert got == {("en", 4, 4), ("de", 2, 2)} and {r["doc_id"] % 4 for r in seen[0].collect()} == {2}


def test_pages_are_parsed_once_for_two_merges(spark, tmp_path, monkeypatch):
    """both merges read the parsed pages."""
    spark.createDataFrame([(k, f"text {k}", "en") for k in range(20)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, real = [], page_queries.ingest.upsert
    monkeypatch.setattr(page_queries.ingest, "upsert", lambda old, new, key: seen.append(new) or real(old, new, key))
    rows = page_queries.stored_articles(spark, str(tmp_path)).collect()
    assert len(rows) == 20 and len(seen) == 2 and all("documents.parquet" not in f for new in seen for f in new.inputFiles())


def test_the_lexicon_is_learnt_once_for_both_sides(spark, tmp_path, monkeypatch):
    """labels are cleaned with tables that are written, whose documents are not read again for each use."""
    spark.createDataFrame([(1, "warm seas rise", "en"), (2, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "seas")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, real = [], classify.best_match
    monkeypatch.setattr(classify, "best_match", lambda docs, labels, *a, **b: seen.append(labels) or real(docs, labels, *a, **b))
    rows = text_queries.lemma_best_match(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "7", 1 / 3), (2, "0", 0.0)]
    assert not [f for f in seen[0].inputFiles() if "documents.parquet" in f]


def test_a_line_of_quads_meets_its_pattern_once(spark, tmp_path):
    """columns and filters do not match the line again, and odd lines are read as ever."""
    lines = [
        "", "  # a comment", '<http://s> <http://p> "a\\\\nb\\n\\"c\\u00e9\\U0001F600" .', '_:s <http://p> ""@en-GB <http://g> . # end', f'<http://s> <http://p> "1"^^<{rdf.XSD}integer> _:g.',
        f'<> <http://p> "x"^^<{rdf.XSD}string>.', "<http://s\\u00e9> <http://p> <> .", "\t<http://s> <http://p> _:o . ", '<http://s> <http://p> "$1 \\\\ \u0085"^^<> .', "no statement", '<http://s> <http://p> "open .',
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "nq"))
    found = rdf.read_nquads(spark, str(tmp_path / "nq"))
    assert found.where("g IS NULL AND s <> ''")._jdf.queryExecution().optimizedPlan().toString().count("[^<>]*)>\\s+") == 1
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [
            ("http://s", "iri", "http://p", 'a\\nb\n"cé😀', "literal", None, None, None), ("_:s", "bnode", "http://p", "", "literal", None, "en-GB", "http://g"), ("http://s", "iri", "http://p", "1", "literal", rdf.XSD + "integer", None, "_:g"),
            ("", "iri", "http://p", "x", "literal", None, None, None), ("http://sé", "iri", "http://p", "", "iri", None, None, None), ("http://s", "iri", "http://p", "_:o", "bnode", None, None, None), ("http://s", "iri", "http://p", "$1 \\ \u0085", "literal", None, None, None),
        ],
        key=str,
    )
    assert [r["value"] for r in rdf.bad_lines(spark, str(tmp_path / "nq")).orderBy("value").collect()] == ['<http://s> <http://p> "open .', "no statement"]
    with pytest.raises(Exception, match="no statement: "):
        rdf.read_nquads(spark, str(tmp_path / "nq"), strict=True).collect()


def test_bound_values_are_computed_once(spark):
    """filters do not repeat what they name, and numbers at the ends of their ranges are what they were."""
    numbers = ["0", "3", "-7", "99999999999", "999999999.5", "-1000000000", "9007199254740993", "0.000000001", "99999999999999999999", "100000000000000000000", "-31622776601.6837933199", "99999999999999999999999999999999999999", "0.125"]
    rows = [(f"http://s/{k}", "iri", "http://v", n, "literal", rdf.XSD + ("decimal" if "." in n else "integer"), None) for k, n in enumerate(numbers)]
    graph = spark.createDataFrame([*rows, ("http://s/x", "iri", "http://v", "1e300", "literal", rdf.XSD + "double", None), ("http://s/y", "iri", "http://v", "word", "literal", None, None)], TRIPLES)
    found = query(graph, "SELECT ?s ?a ?b ?c ?d { ?s <http://v> ?v BIND(?v + 1 AS ?a) BIND(?a * ?a AS ?b) BIND(?b - ?a AS ?c) BIND(?a / 8 AS ?d) FILTER(?c != 5 && ?a = ?a) }")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("transform(") < 45
    got = {r["s"][9:]: (r["a"], r["b"], r["c"], r["d"]) for r in found.collect()}
    assert got == {
        "0": ("1", "1", "0", "0.125"), "1": ("4", "16", "12", "0.5"), "2": ("-6", "36", "42", "-0.75"), "3": ("100000000000", "10000000000000000000000", "9999999999900000000000", "1.25E10"),
        "4": ("1000000000.5", "1000000001000000000.25", "999999999999999999.75", "125000000.0625"), "5": ("-999999999", "999999998000000001", "999999999000000000", "-124999999.875"), "6": ("9007199254740994", "81129638414606717724586024108036", "81129638414606708717386769367042", "1.1258999068426242E15"), "7": ("1.000000001", "1.000000002000000001", "0.000000001", "0.125000000125"),
        "8": ("100000000000000000000", "1.0E40", "1.0E40", "1.25E19"), "9": ("100000000000000000001", "1.0E40", "1.0E40", "1.25E19"), "10": ("-31622776600.6837933199", "9.999999999367544E20", "9.999999999683772E20", "-3.952847075085474E9"), "11": ("1.0E38", "9.999999999999999E75", "9.999999999999999E75", "1.25E37"),
        "12": ("1.125", "1.265625", "0.140625", "0.140625"), "x": ("1.0E300", "Infinity", "Infinity", "1.25E299"),
    }
    kept = query(graph, "SELECT ?s { ?s <http://v> ?v FILTER(?v > 99999999999999999999.4) }").collect()
    assert sorted(r["s"][9:] for r in kept) == ["11", "x"]
    assert {r["s"][9:] for r in query(graph, 'SELECT ?s { ?s <http://v> ?v FILTER(?v != "word") }').collect()} == {*map(str, range(len(numbers))), "x"}
    assert query(graph, "SELECT ?s { ?s <http://v> ?v BIND(RAND() AS ?r) FILTER(?r >= 0 && ?r = ?r) }").count() == len(rows) + 2
