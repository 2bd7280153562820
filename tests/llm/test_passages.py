"""The law of sums against simulation, and the aggregate against a search over all sets of segments."""

import itertools
import math
import random

import numpy as np

from claimloom.llm import toxicity


def test_law_of_sums_by_simulation():
    rng = np.random.default_rng(3)
    for r in (1, 2):
        sums = -np.log(np.cumsum(rng.exponential(size=(2_000_000, r)), axis=1)).sum(axis=1)  # the r best of a Poisson process
        t = r * (r + 1.0) + 1
        law = math.exp(-t) * t ** (r - 1) / (math.factorial(r) * math.factorial(r - 1))
        assert 0.5 < (sums >= t).mean() / law < 2


def test_aggregate_is_the_best_set():
    rng = random.Random(4)
    for _ in range(200):
        x = [rng.uniform(-3, 14) for _ in range(rng.randint(1, 6))]
        best = max(x)
        top = sorted(x, reverse=True)
        for r in range(2, len(x) + 1):
            total = max(sum(c) for c in itertools.combinations(x, r))
            if total < r * (r + 1) or top[r - 1] <= 0:
                break
            chance = math.exp(-total) * total ** (r - 1) / (math.factorial(r) * math.factorial(r - 1))
            best = max(best, -math.log(chance * 2 ** (r - 1)))
        assert math.isclose(toxicity.sum_evidence(x), best, rel_tol=1e-9, abs_tol=1e-9)


def test_several_passages_say_more_than_one():
    model = toxicity.ToxicityModel({"bad": 2.0}, 0.25, 1.0, 0.0, (0.0, 1.0))
    once, twice = "x " * 40 + "bad bad bad bad bad " + "x " * 80, "x " * 40 + "bad bad bad bad bad " + "x " * 40 + "bad bad bad bad bad " + "x " * 35
    assert len(once.split()) == len(twice.split())
    assert model.score(twice) > model.score(once)


def test_all_terms_of_the_sample_count(spark, make):
    """Each of many words is known by its own texts: none is cut off."""
    words = ["bad" + "".join(random.Random(i).choices("bcdfghjklm", k=8)) for i in range(300)]
    docs = [(i, f"{words[i // 8]} " * (1 + i % 8) + "plain words of a text here " * 4) for i in range(2400)] + [(5000 + i, "plain words of a text here " + "".join(chr(97 + int(c)) for c in str(i))) for i in range(2400)]
    labels = spark.createDataFrame([(i, 1, int(i < 5000)) for i, _ in docs], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(make(docs), labels, deviations=1.0)
    assert sum(w in model.weights for w in words) >= 290
