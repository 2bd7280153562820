"""Words beyond the first characters of a text count."""

import re

import pytest

from claimloom import queries
from claimloom.functions.text import STOP_WORDS

FILLER = "filler words " * 30
DOCS = [(1, FILLER + "melting glaciers rise"), (2, "solar cycles warm " + FILLER), (3, FILLER), (4, None), (5, FILLER + "glaciers " + FILLER + "solar")]
ITEMS = [(1, "melting glaciers"), (2, "solar cycles warm planets"), (3, "nothing alike")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, "en", "s") for i, t in DOCS], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def words(t):
    return set(re.findall("[a-z]+", (t or "").lower())) - set(STOP_WORDS)


def brute():
    return {(i, k): len(words(t) & words(x)) / max(1, len(words(t) | words(x))) for i, t in DOCS for k, x in ITEMS}


def test_matching_of_whole_texts(spark, tables):
    want = brute()
    got = {(r["key"], r["label_id"]): r["similarity"] for r in queries.Q["jaccard_cross"](spark, tables).collect()}
    assert got == pytest.approx(want)
    got = {(r["key"], r["label_id"]): r["similarity"] for r in queries.Q["jaccard_inverted"](spark, tables).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0}) and (1, 1) in got
    got = {r["key"]: r["category"] for r in queries.Q["jaccard_best_match"](spark, tables).collect()}
    assert got == {1: "1", 2: "2", 3: "0", 4: "0", 5: "1"}


def test_flagship_matches_whole_texts(spark, tables, monkeypatch):
    seen, real = [], queries.triples.article_triples
    monkeypatch.setattr(queries.triples, "article_triples", lambda rows, config: seen.append(rows) or real(rows, config))
    assert queries.flagship(spark, tables).count()
    assert {r["url"][-1]: r["category"] for r in seen[0].select("url", "category").collect()} == {"1": "1", "2": "2", "3": "0", "4": "0", "5": "1"}


def test_keywords_of_whole_texts(spark, tables):
    got = sorted((r["doc_id"], r["keyword"]) for r in queries.Q["keywords_explode"](spark, tables).collect())
    assert got == sorted((i, w) for i, t in DOCS if t is not None for w in t.split(" "))
