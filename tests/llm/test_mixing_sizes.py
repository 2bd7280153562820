"""Raking and the draw against plain loops, for few cells and for many, where the weights move slowly."""

import random

import numpy as np
import pytest

from claimloom.llm import mixing

DIMS = mixing.DIMS


def brute_rake(cells, wanted, damping):
    """Sweeps over a dictionary of cells until nothing moves."""
    cells = {k: float(n) for k, n in cells.items()}
    total = sum(cells.values())
    goals = []
    for d in range(3):
        sums = {}
        for k, n in cells.items():
            if n:
                sums[k[d]] = sums.get(k[d], 0.0) + n / total
        goal = {g: max(0.0, wanted[d].get(g, 0.0)) if wanted[d] is not None else s**damping for g, s in sums.items()}
        mass = sum(goal.values())
        goals.append({g: x / mass if mass else 1 / len(goal) for g, x in goal.items()})
    weight = {k: n / total for k, n in cells.items()}
    for _ in range(5000):
        before = dict(weight)
        for d in range(3):
            now = {}
            for k, w in weight.items():
                now[k[d]] = now.get(k[d], 0.0) + w
            weight = {k: w * goals[d].get(k[d], 0.0) / now[k[d]] if now[k[d]] else 0.0 for k, w in weight.items()}
            mass = sum(weight.values())
            weight = {k: w / mass for k, w in weight.items()}
        if max(abs(weight[k] - before[k]) for k in weight) < 1e-13:
            break
    return weight


def brute_chances(cells, weight, keep):
    """The scale by halving."""
    low, high = 0.0, 1e15
    chance = lambda k, c: min(1.0, c * weight[k] / cells[k]) if cells[k] else 1.0
    for _ in range(300):
        c = (low + high) / 2 if low else high / 2 if high < 1e-9 else (low + high) / 2
        got = sum(n * chance(k, c) for k, n in cells.items())
        low, high = (c, high) if got < keep * sum(cells.values()) else (low, c)
    return {k: chance(k, high) for k in cells}


RNG = random.Random(9)
FEW = {("a", "en", "t"): 9000, ("a", "de", "t"): 30, ("b", "en", "t"): 5, ("b", "de", "t"): 500}
MANY = {(f"s{i}", lang, topic): RNG.randint(0, 10 ** RNG.randint(1, 5)) for i in range(150) for lang in ("en", "de", "fr") for topic in ("x", "y") if RNG.random() < 0.7}


@pytest.mark.parametrize(
    ("cells", "wanted"),
    [
        (FEW, ({"a": 0.6, "b": 0.4}, {"en": 0.3, "de": 0.7}, None)),
        (FEW, ({}, {"en": -1.0, "de": 1.0}, None)),
        (MANY, (None, {"en": 0.5, "de": 0.3, "fr": 0.2}, {"x": 0.4, "y": 0.6})),
        (MANY, ({f"s{i}": float(i) for i in range(0, 150, 2)}, None, None)),
    ],
)
def test_raking_by_brute_force(spark, cells, wanted):
    table = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens long")
    raked = mixing.rake(table, dict(zip(DIMS, wanted, strict=True)), 0.7)
    got = {tuple(r[d] for d in DIMS): (r["weight"], r["probability"]) for r in mixing.probabilities(raked, 0.3).collect()}
    want = brute_rake(cells, wanted, 0.7)
    assert got.keys() == want.keys() and np.allclose([got[k][0] for k in want], list(want.values()), rtol=0, atol=1e-8)
    chance = brute_chances(cells, want, 0.3)
    assert np.allclose([got[k][1] for k in chance], list(chance.values()), rtol=1e-5, atol=1e-7)


def test_too_many_small_groups_are_told(spark):
    table = spark.createDataFrame([("s", f"l{i}", "t", 1) for i in range(20)], "source string, lang string, topic string, tokens long")
    with pytest.raises(ValueError, match="pairs of language and topic"):
        mixing.rake(table, dict.fromkeys(DIMS), 0.7, most_pairs=10)


def test_tells_what_is_missed(spark):
    """Raking that ends before its targets are met says by how much."""
    import pytest

    from claimloom.llm.mixing import rake

    cells = spark.createDataFrame([("a", "en", "x", 5), ("b", "fr", "y", 7), ("a", "fr", "x", 2)], "source string, lang string, topic string, tokens long")
    against = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "fr": 0.9}, "topic": {"x": 0.1, "y": 0.9}}  # source a is topic x alone
    with pytest.warns(RuntimeWarning, match="misses its target by up to 0[.]"):
        rake(cells, against, sweeps=2).collect()
