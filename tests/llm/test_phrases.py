"""Phrases against plain loops over all occurrences."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from claimloom.llm import phrases
from tests.llm.conftest import ODD


def plain(rows, least=10, longest=3, share=50, top=2000):
    count, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    key = lang, tuple(words[i : i + n])
                    count[key] = count.get(key, 0) + 1
    out = {}
    for (lang, p), a in count.items():
        if len(p) < 2 or a < least:
            continue
        if any(x == lang and len(q) > len(p) and 100 * f >= share * a and f >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), f in count.items()):
            continue
        score, k = min((10**6 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "c", "é", "Z", "dd", "x\x00", " "]
    return [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " - "]) for _ in range(rng.randrange(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "longest", "shard"), [(1, 3, 2_000_000), (2, 3, 50), (3, 4, 200), (4, 2, 300)])
def test_against_loops(spark, make, seed, longest, shard):
    rows = texts(seed)
    docs = make([(i, t, lang) for i, (lang, t) in enumerate(rows)])
    for top in (2000, 7):
        got = phrases.mine_phrases(docs, most_words=longest, shard_words=shard, top=top, sieve_bits=1 << 10)
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, longest=longest, top=top)


def test_suffixes():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 4, 300).astype(np.int32)
    order = phrases.suffix_order(ids, 3)
    firsts = [tuple(ids[i : i + 3]) for i in order]
    assert firsts == sorted(firsts) and sorted(order) == list(range(300))
    for n, at, count in phrases.intervals(ids, 3):
        want = Counter(tuple(ids[i : i + n]) for i in range(300 - n + 1) if 0 not in ids[i : i + n])
        assert {tuple(ids[i : i + n]): c for i, c in zip(at, count, strict=True)} == want
    assert [len(at) for _, at, _ in phrases.intervals(np.zeros(0, np.int32), 3)] == [0, 0, 0]


def test_odd_tables(spark, odd, make):
    got = [tuple(r) for r in phrases.mine_phrases(odd).collect()]
    assert sorted(got) == plain([("en", t) for _, t in ODD])
    assert phrases.mine_phrases(make([])).count() == 0
    assert phrases.mine_phrases(make([(1, None, None), (2, "", "en")])).count() == 0


def test_counts_past_64_bits(spark):
    score = spark.sql("SELECT (cast(a AS decimal(16,0)) * cast(a AS decimal(16,0)) * 1000000) div (cast(l AS decimal(16,0)) * cast(r AS decimal(16,0))) FROM VALUES (3000000001L, 5000000003L, 7000000001L) AS t(a, l, r)").first()[0]
    assert score == 10**6 * 3000000001**2 // (5000000003 * 7000000001)
