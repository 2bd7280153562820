"""What nulls, empty and very long texts, ties and repeated rows give, value by value; the pipeline over such tables."""

import hashlib
import zlib

import pytest

from claimloom.llm import decontaminate, jpeg, langid, line_dedup, mixing, near_dedup, pii, quality, toxicity
from tests.llm.conftest import ODD



def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_surrogates(odd):
    assert rows_of(pii.pseudonymize(odd, b"k"), "doc_id", "text", "n_entities") == sorted(((i, t, 0) for i, t in ODD), key=lambda r: (r[0] is None, r[0] or 0))


def test_benchmark_spans(spark, odd):
    bench = spark.createDataFrame([(1, "plain text of a few words"), (None, None), (2, "id at all"), (3, "id at all")], "item_id long, text string")
    got = rows_of(decontaminate.find_benchmark_spans(odd, bench), "doc_id", "n_words", "n_hit", "items", "contaminated")
    assert got == [(1, 6, 6, ["1"], True)] * 2 + [(2, 0, 0, [], False), (3, 0, 0, [], False), (4, 0, 0, [], False), (5, 30_000, 0, [], False), (None, 5, 3, ["2", "3"], True)]
    kept = rows_of(decontaminate.decontaminate(odd, bench), "doc_id", "gone")
    assert kept == [(2, "w"), (3, "w"), (4, "w"), (5, "w")]


def test_near_duplicates(make, odd):
    got = rows_of(near_dedup.link_near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert got == [(1, 2, 1, True)] * 2 + [(2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (None, 1, None, True)]
    ties = make([(9, "a b c d e f"), (7, "A  b c d e f"), (8, "a b c d e f"), (3, "x")])
    assert rows_of(near_dedup.link_near_duplicates(ties), "doc_id", "component_id", "kept") == [(3, 3, True), (7, 7, True), (8, 7, False), (9, 7, False)]


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_scores(spark, odd, which):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (5, None, None), (None, 1, 1), (4, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score_quality(odd, quality.fit_quality(odd, labels)) if which == "quality" else toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, labels))
    got = rows_of(scored, "doc_id", "score")
    assert [i for i, _ in got] == [1, 1, 2, 3, 4, 5, None] and all(0 <= s <= 1 for _, s in got)
    assert got[0] == got[1] and got[2][1] == got[3][1]  # repeated rows; null as empty


def test_mixture(odd):
    got = rows_of(mixing.mix(odd, keep=1.0), "doc_id", "n_tokens", "source", "lang", "kept")
    assert got == [(1, 6, "s", "en", True)] * 2 + [(2, 0, "s", "en", True), (3, 0, "s", "en", True), (4, 0, "s", "en", True), (5, 30_000, "s", "en", True), (None, 5, "s", "en", True)]


def test_media(odd):
    for r in jpeg.read_digests(jpeg.store_texts(odd)).collect():
        text = next(t for i, t in ODD if i == r["doc_id"]) or ""
        payload = jpeg.pad(text.encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_languages(make, odd):
    known = make([(i, "der die das und " * 20, "de") for i in range(40)] + [(100 + i, "the of and with " * 20, "en") for i in range(40)])
    parser = langid.fit_languages(known)
    got = rows_of(langid.identify_languages(odd, parser), "doc_id", "lang_pred")
    assert [g for g in got if g[0] in (2, 3, 4)] == [(2, "und"), (3, "und"), (4, "und")] and {p for i, p in got if i in (1, 5, None)} <= {"de", "en"}
    tie = langid.LanguageParser({"b": "same text", "a": "same text", "c": "same text"}, {"a": 1, "b": 1, "c": 2}, 1000)
    assert tie.predict(["same"])[0] == ["c"] and langid.LanguageParser({"b": "same", "a": "same"}, {"a": 1, "b": 1}, 99).predict(["same"])[0] == ["a"]


def test_lines(make, odd):
    got = rows_of(line_dedup.dedup_lines(odd), "doc_id", "n_lines", "n_dropped", "kept_text")
    assert got == sorted(((i, (t or "").count("\n") + 1, 0, t or "") for i, t in ODD), key=lambda r: (r[0] is None, r[0] or 0))
    line = "a line that is long enough to count as one of them"
    twice = make([(i, f"{line}\nown {i}\n{line}") for i in range(5)] + [(4, line)])  # one id with two texts

    assert {(r["doc_id"], r["n_dropped"]) for r in line_dedup.dedup_lines(twice).collect()} == {(0, 2), (1, 2), (2, 2), (3, 2), (4, 0)}


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "plain text of a few words")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        d = str(tmp_path / name)
        for table, rows in (("documents", docs), ("benchmark", bench), ("labels", labels)):
            rows.write.parquet(f"{d}/{table}.parquet")
        kept = spark.read.parquet(f"{d}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:4]:
            kept = stage(spark, kept, d)
            assert kept.columns == odd.columns, stage_name
        left = rows_of(kept, "doc_id")
        out = rows_of(corpus_pipeline.run(spark, d), "doc_id", "start", "n_tokens")
        assert [(i,) for i, _, _ in out] == left and {i for (i,) in left} <= {2, 3, 4, 5, None}  # 1 holds the benchmark
        at = 0
        for _, start, n in sorted(out, key=lambda r: (r[0] is not None, r[0] or 0)):
            assert start == at
            at += n
        assert bool(out) == (name == "odd")
