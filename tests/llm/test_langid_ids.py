"""What the fit of languages takes from repeated ids, and ids that are no numbers."""

from claimloom.llm import langid


def test_a_repeated_id_gives_one_text_to_the_fit_and_ids_may_be_strings(spark):
    rows = [(f"d{k % 3}" if k < 300 else f"e{k}", f"the words of number {k} are here", "en") for k in range(330)]
    rows += [(f"f{k}", f"les mots du nombre {k} sont ici", "fr") for k in range(60)] + [("g", None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    parser = langid.fit_languages(docs)
    out = langid.identify_languages(docs, parser).collect()
    assert len(out) == len(rows) and {r["lang_pred"] for r in out if r["doc_id"] == "g"} == {"und"}
    assert all(r["lang_pred"] == ("fr" if r["doc_id"].startswith("f") else "en") for r in out if r["doc_id"] != "g")
    again = langid.fit_languages(docs.unionByName(docs))
    assert parser.langs == again.langs
