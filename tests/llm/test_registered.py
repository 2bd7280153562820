"""Registered queries against their SQL, and the pipeline against its stages' brute force, at the smallest size."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_queries_with_sql(spark):
    from claimloom.llm import queries
    from tests.test_queries import compare

    for name, sql in queries.oracle_sql().items():
        assert compare(spark, queries.queries()[name], sql), name


def test_pipeline(spark):
    import corpus_pipeline
    from claimloom.llm import near_dedup, queries, toxicity
    from tests.llm.test_operators import brute_hits

    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit_toxicity(docs, spark.read.parquet(str(DATA / "labels.parquet")))
    left = {i: t for i, t in texts.items() if model.score(t or "") < 0.5}
    sets = {i: set(near_dedup.shingle_set(t.encode()).tolist()) for i, t in left.items()}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and label[a] > label[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    left = {i: t for i, t in left.items() if label[i] == i}
    bench = [tuple(r) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).select("item_id", "text").collect()]
    left = {i: left[i] for i, _, hit, _ in brute_hits(list(left.items()), bench) if not hit}
    frame = docs.where(docs.doc_id.isin(list(left)))
    for (_, stage), n in zip(corpus_pipeline.STAGES[:3], range(3), strict=False):
        docs = stage(spark, docs, str(DATA))
    assert {r["doc_id"] for r in docs.collect()} == set(left)
    drawn = corpus_pipeline.mixture(spark, frame, str(DATA))
    want = sorted(map(tuple, queries.token_files(drawn).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(DATA)).collect())) == want and want
