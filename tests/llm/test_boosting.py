"""One step of the boosting against a search of all cuts, and features that see the end of a text."""

import itertools
import random

import numpy as np

from claimloom.llm import quality


def gain(g, w, parts, ridge):
    return sum(sum(g[i] for i in p) ** 2 / (sum(w[i] for i in p) + ridge) for p in parts)


def test_line_tree_takes_the_best_cut():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 9)
        g, w = [rng.uniform(-2, 2) for _ in range(n)], [rng.uniform(0.1, 2) for _ in range(n)]
        got = quality._line_tree(np.array(g), np.array(w), 4.0, cuts=1)
        cuts = [[range(n)]] + [[range(k), range(k, n)] for k in range(1, n)]
        best = max(cuts, key=lambda parts: gain(g, w, parts, 4.0))
        want = [sum(g[j] for j in p) / (sum(w[j] for j in p) + 4.0) for p in best for _ in p]
        assert np.allclose(got, want)


def test_a_round_of_cuts_is_greedy():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randint(4, 10)
        g, w = [rng.uniform(-2, 2) for _ in range(n)], [rng.uniform(0.1, 2) for _ in range(n)]
        parts = [list(range(n))]
        for _ in range(3):
            tries = [[*parts[:k], p[:c], p[c:], *parts[k + 1 :]] for k, p in enumerate(parts) for c in range(1, len(p))]
            best = max(tries, key=lambda t: gain(g, w, t, 4.0))
            if gain(g, w, best, 4.0) <= gain(g, w, parts, 4.0) + 1e-9:
                break
            parts = best
        want = np.zeros(n)
        for p in parts:
            want[p] = sum(g[j] for j in p) / (sum(w[j] for j in p) + 4.0)
        assert np.allclose(quality._line_tree(np.array(g), np.array(w), 4.0), want)


def test_square_tree_takes_the_best_pair_of_cuts():
    rng = random.Random(7)
    for _ in range(40):
        a, b = rng.randint(2, 5), rng.randint(2, 5)
        g, w = np.array([[rng.uniform(-2, 2) for _ in range(b)] for _ in range(a)]), np.array([[rng.uniform(0.1, 2) for _ in range(b)] for _ in range(a)])
        best, want = -1.0, None
        for r, c in itertools.product(range(1, a), range(1, b)):
            leaf = np.empty((a, b))
            total = 0.0
            for rows, cols in itertools.product((slice(0, r), slice(r, a)), (slice(0, c), slice(c, b))):
                leaf[rows, cols] = g[rows, cols].sum() / (w[rows, cols].sum() + 4.0)
                total += g[rows, cols].sum() ** 2 / (w[rows, cols].sum() + 4.0)
            if total > best:
                best, want = total, leaf
        got, found = quality._square_tree(g, w, 4.0)
        assert np.allclose(got, want) and np.isclose(found, best)


def test_features_see_all_of_a_text():
    plain = ("some words of a text that goes on and on. " * 300).encode()
    place = {n: k for k, n in enumerate(quality.FEATURES)}
    for tail, name in ((b" junk***" * 300, "marked_words"), (b" spam" * 3000, "top_word"), (b" spam" * 3000, "near_distinct"), (b" ###" * 300, "mark_runs")):
        assert quality.features(plain + tail)[place[name]] != quality.features(plain)[place[name]]
    assert len(quality.features(b"")) == len(quality.FEATURES)


def test_bounded_sample_takes_one_text_of_an_id(spark, make):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    docs = make([(i, f"text {i} of {k}") for i in range(20) for k in range(30)])
    from claimloom.llm.common import labelled_sample

    rows = labelled_sample(docs, labels, "quality", 5, 0, 8).collect()
    assert len(rows) == 8 and all(r["text"].endswith("of 0") for r in rows)
