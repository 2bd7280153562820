"""Whitening against the whole covariance matrix and exact integers."""

import numpy as np
import pytest

from claimloom.llm.whitening import Whitening, fit_whitening, whitened_rows

SCHEMA = "vec_id long, embedding array<float>, component string, n string, label int"


def table(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, v, "x", "y", 1) for i, v in enumerate(vectors)], SCHEMA)


@pytest.mark.parametrize(("wide", "widest"), [(5, 128), (40, 128), (150, 48)])
def test_against_the_whole_matrix(spark, wide, widest):
    rng = np.random.default_rng(wide)
    data = (rng.standard_normal((400, wide)) * (0.2 + rng.random(wide)) + rng.random(wide)).astype(np.float32)
    rows = table(spark, data.tolist())
    fit = fit_whitening(rows, widest=widest)
    x = np.floor(1024 * data.astype(float)).astype(np.int64) + 100_000
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    k = min(8, wide)
    assert fit.n == 400 and np.allclose(fit.variances, values[::-1][:k], rtol=1e-11)
    assert np.allclose(np.abs((fit.basis * vectors[:, ::-1][:, :k]).sum(0)), 1, atol=1e-10)
    got = whitened_rows(rows, fit).orderBy("vec_id", "component").collect()
    assert len(got) == 400 * k and got[0]["identity_error"] < 1e-9
    sums = x.sum(0)
    want = (x - sums / 400) @ vectors[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])
    for i in (0, 7, 399):
        assert got[i * k]["deviation"] == sum((400 * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert np.allclose(np.abs([r["whitened"] for r in got[i * k : i * k + k]]), np.abs(want[i]), atol=1e-7)
    assert abs(got[0]["explained"] - values[-1] / values.sum()) < 1e-9
    if wide == 150:
        assert fit.passes < 60  # a thinned subspace goes on


def test_odd_rows(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [3.0, 5.0]]
    rows = spark.createDataFrame(
        [(1, good[0], None, None, None), (1, good[0], None, None, None), (None, good[1], None, None, None), (2, good[2], None, None, None), (3, None, None, None, None), (4, [1.0, None], None, None, None), (5, [float("nan"), 1.0], None, None, None), (6, [1.0, float("-inf")], None, None, None)],
        SCHEMA,
    )
    got = whitened_rows(rows, fit_whitening(rows)).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == [(0, 1, 4), (0, 2, 4)] + [(1, 1, 4)] * 2 + [(1, 2, 4)] * 2 + [(2, 1, 4), (2, 2, 4)]
    same = table(spark, [[1.0, 1.0]] * 3)
    line = table(spark, [[1.0, 1.0], [2.0, 2.0], [4.0, 4.0]])
    none = rows.where("vec_id = 3")
    assert whitened_rows(same, fit_whitening(same)).count() == 0 and whitened_rows(none, fit_whitening(none)).count() == 0 and whitened_rows(rows.limit(0), fit_whitening(rows.limit(0))).count() == 0
    assert {r["component"] for r in whitened_rows(line, fit_whitening(line)).collect()} == {1}
    with pytest.raises(ValueError, match="entries"):
        fit_whitening(table(spark, [[1.0], [1.0, 2.0]]))
    named = line.selectExpr("cast(vec_id as string) || 'a' AS vec_id", "embedding")
    assert {r["vec_id"] for r in whitened_rows(named, fit_whitening(named)).collect()} == {"0a", "1a", "2a"}


def test_exact_deviation():
    fit = Whitening(3_000_000_000, [3_000_000_000 * 100_000 + 1] * 2, np.zeros((2, 0)), np.zeros(0), 1.0)
    x = np.array([[100_000, 900_000], [1 << 50, 100_000]])
    assert fit.deviation(x) == [sum((fit.n * int(a) - s) ** 2 for a, s in zip(row, fit.sums, strict=True)) for row in x]
