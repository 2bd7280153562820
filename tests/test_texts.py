"""What is learnt from texts: base forms, names, languages."""

import pytest

from claimloom.functions.text import clean_tokens
from claimloom.operators import classify, ingest, language, lexicon
from claimloom.schemas import CLAIMS, MAPPINGS

STEMS = "walk talk jump work play help look turn call paint climb"


@pytest.fixture(scope="module")
def learnt(spark):
    families = " ".join(f"{w} {w}s {w}ed {w}ing" for w in STEMS.split()) + " city cities party parties lady ladies pony ponies story stories baby babies species moving move was"
    rows = [(1, families), (2, "We met Berlin, then Berlin again. She saw Berlin and may stay. Turn left. Turn right. We may go"), (3, None)]
    texts = spark.createDataFrame(rows, "id int, text string")
    words = lexicon.vocabulary(texts, "text")
    edits = lexicon.suffix_edits(words)
    return edits, lexicon.lemmas(words, edits), lexicon.proper_nouns(texts, "text")


def test_lexicon(spark, learnt):
    edits, table, names = learnt
    found = {(r["ending"], r["base_ending"]) for r in edits.collect()}
    assert {("s", ""), ("ed", ""), ("ing", ""), ("ies", "y")} <= found
    base = {r["word"]: r["lemma"] for r in table.collect()}
    assert base["walking"] == "walk" and base["talked"] == "talk" and base["cities"] == "city" and base["babies"] == "baby"
    assert "was" not in base and "walk" not in base and "species" not in base
    assert {r["word"] for r in names.collect()} == {"berlin"}


def test_cleaned_texts_meet_by_base_forms(spark, learnt):
    _, table, names = learnt
    texts = spark.createDataFrame([(1, "Berlin walks; seven cities, walking!"), (2, None), (3, "the of"), (4, "Talked")], "id int, text string")
    got = {r["key"]: r["tokens"] for r in lexicon.clean_texts(texts, "id", "text", table, names).collect()}
    assert got == {1: ["city", "walk"], 2: [], 3: [], 4: ["talk"]}
    labels = spark.createDataFrame([("9_1", "a city to walk", 0), ("9_2", "Berlin", 1)], "id string, text string, ord int")
    clean = lexicon.clean_texts(labels.drop("ord"), "id", "text", table, names)
    best = classify.best_match(lexicon.clean_texts(texts, "id", "text", table, names), clean, "key", "tokens", "key", "tokens", "key", tokens=lambda c: c)
    assert {r["key"]: r["category"] for r in best.collect()} == {1: "9_1", 2: "0", 3: "0", 4: "0"}
    plain = classify.best_match(texts, labels, "id", "text", "id", "text", "ord", tokens=clean_tokens)
    assert {r["key"]: r["category"] for r in plain.collect()}[1] == "0"  # no word in common but a name


def test_languages(spark):
    known = spark.createDataFrame([("en", "the weather is getting warmer and the sea is rising"), ("de", "das wetter wird wärmer und das meer steigt an"), ("de", None), (None, "x")], "lang string, text string")
    table = language.profiles(known, "text", "lang")
    assert {r["lang"] for r in table.collect()} == {"en", "de"}
    claims = spark.createDataFrame([("r1", "2024", "the sea and the weather"), ("r2", "2024", "das meer und das wetter"), ("r3", "2024", "12 + 3"), ("r4", "2024", " ")], CLAIMS)
    got = ingest.new_mappings(claims, spark.createDataFrame([], MAPPINGS), table)
    assert {r["url"]: r["lang"] for r in got.collect()} == {"r1": "en", "r2": "de", "r3": None} and got.columns == MAPPINGS.replace(" string", "").split(", ") + ["category_state"] * ("category_state" not in MAPPINGS)


def test_scorer(spark, tmp_path):
    """The fit against plain numpy, held-out texts, a model that is saved, loaded and used as a stage."""
    import numpy as np

    from claimloom.operators import scorer

    rows = [(f"the {w} number {i}", c) for i in range(60) for w, c in (("glacier", "ice"), ("volcano", "fire"), ("ocean", "sea"))] + [(None, "ice"), ("glacier", None), ("x", "other")]
    texts = spark.createDataFrame(rows, "text string, label string").repartition(4)
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    classes = ("ice", "fire", "sea")
    model = scorer.fit(texts, "text", "label", classes, bits=12, rounds=5)
    known = [(scorer.hashed(t, 12), classes.index(c)) for t, c in rows if t is not None and c in classes]
    x = np.zeros((len(known), 4096))
    for i, ((at, value), _) in enumerate(known):
        x[i, at] = value
    y = np.eye(3)[[c for _, c in known]]
    w, squares = np.zeros((3, 4096)), np.full((3, 4096), 1e-8)
    for _ in range(5):
        p = np.exp(x @ w.T)
        step = ((p / p.sum(1, keepdims=True)) - y).T @ x / len(x) + 1e-4 * w
        squares += step**2
        w = w - 0.5 * step / np.sqrt(squares)
    assert np.allclose(model.weights, w, atol=1e-8)
    model.save(spark, str(tmp_path / "m"))
    again = scorer.load(spark, str(tmp_path / "m"))
    assert again.classes == classes and np.array_equal(again.weights, model.weights)
    held = ["the glacier number 99", "the volcano number 99", "the ocean number 99", ""]
    assert [classes[int(s.argmax())] for s in again.scores(held)][:3] == ["ice", "fire", "sea"]
    fire = scorer.fit(texts.selectExpr("text", "CASE WHEN label = 'ice' THEN '0' WHEN label IS NOT NULL THEN '1' END AS y"), "text", "y", ("0", "1"), bits=12, rounds=10)
    staged = classify.two_stage(spark.createDataFrame([(t,) for t in [*held[:3], None]], "t string"), "t", fire.loader(spark), again.loader(spark), None, classes)
    assert {r["t"]: r["category"] for r in staged.collect()} == {held[0]: "0", held[1]: "fire", held[2]: "sea", None: None}
    none = scorer.fit(texts.where("text = 'nowhere'"), "text", "label", classes, bits=4)
    assert not none.weights.any()


def test_similar_pairs_against_all_pairs(spark):
    import random

    draw = random.Random(5)
    words = [a + b for a in "bcdfgklm" for b in ("ar", "en", "il", "ok", "us")]
    texts = [(k if k % 17 else None, " ".join(draw.choices(words[: draw.choice((6, 20, 40))], k=draw.randrange(0, 9)))) for k in range(300)]
    labels = [(k, " ".join(draw.choices(words[: draw.choice((6, 20, 40))], k=draw.randrange(0, 9))), -k) for k in range(80)]
    texts += [(1, texts[1][1]), (2, "bar ben bil bok"), (500, None), *((1000 + k, "bar") for k in range(50))]
    labels += [(900, None, 0), (901, "bar ben bil bok", 5)]
    left, right = spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame(labels, "id long, label string, ord long")
    old, classify.SHARE_ROWS = classify.SHARE_ROWS, 7  # many shares for frequent tokens
    try:
        for least in (0.01, 0.25, 1 / 3, 0.5, 0.7, 1.0):
            want = set()
            for key, text in texts:
                for label_id, label, order in labels:
                    a, b = set((text or "").split()), set((label or "").split())
                    if a & b and len(a & b) / len(a | b) >= least:
                        want.add((key, label_id, order, len(a & b) / len(a | b)))
            got = [tuple(r) for r in classify.similar(left, right, "key", "text", "id", "label", "ord", least).collect()]
            assert len(got) == len(set(got)) and set(got) == want and want
        empty = classify.similar(left, right.limit(0), "key", "text", "id", "label", "ord", 0.5)
        assert empty.count() == 0
        best = classify.best_match(left.where("key > 2"), right, "key", "text", "id", "label", "ord", 0.4).where("category <> '0'")
        quick = classify.best_match(left.where("key > 2"), right, "key", "text", "id", "label", "ord", 0.4, below=False).where("category <> '0'")
        assert {tuple(r) for r in best.collect()} == {tuple(r) for r in quick.collect()} and best.count() > 50
    finally:
        classify.SHARE_ROWS = old
