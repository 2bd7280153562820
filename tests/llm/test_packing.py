"""Packing against the tokenizer itself, plain best fit and the least number of sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimloom.llm import packing
from tests.llm.conftest import ODD

NAME = "byte_bpe_50k.json"
HARD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "a\t b", "a\t \nb", "x  foo", "x  foo", "x y", "don't 'tis it's.", "?. ?? a.)", "Größe, naïve. Ça", "日本語 テキスト。", "a\0b c", "é x", "1234 5,678.90 abc12", "<|endoftext|> x <| y", "a\r\nb", "\x1cz \x85q", " lead  and trail  ", "ÿ. ß! \n- x\n-\ny", "🙂 🙂x"]


def test_encoder_against_the_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(NAME))
    encoder = packing.SpacedEncoder(NAME, "<u2", most=50)
    rng = random.Random(5)
    parts = [*HARD, "word", " ", "  ", "\n", ".", "'", "É", "ok,"]
    texts = HARD + ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(3000)]
    for text in texts:
        assert list(np.frombuffer(encoder.encode(text.encode()), "<u2")) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    other = packing.SpacedEncoder("word_bpe_49k.json", "<u2")
    assert not other.cut and list(np.frombuffer(other.encode(b"Some Text."), "<u2")) == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("Some Text.", add_special_tokens=False).ids


def seats(plan, counts):
    """(sequence, offset, length) of each rank, by walking the segments."""
    out = []
    for rank in range(sum(counts.values())):
        at = int(np.searchsorted(plan.ranks, rank, side="right")) - 1
        nth, within = divmod(rank - int(plan.ranks[at]), int(plan.per[at]))
        out.append((int(plan.sequence[at]) + nth, int(plan.offset[at]) + within * int(plan.length[at]), int(plan.length[at])))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_plans_hold_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = {rng.randrange(1, capacity + 1): rng.choice([1, 2, 7, 300]) for _ in range(rng.randrange(1, 60))}
    groups = rng.choice([1, 4, 64])
    plan = packing.plan_packing(counts, capacity, groups=groups, large=rng.choice([0.1, 0.3, 0.45]))
    got = seats(plan, counts)
    assert [x for _, _, x in got] == [x for x in sorted(counts, reverse=True) for _ in range(counts[x])]
    ends: dict[int, int] = {}
    for sequence, offset, length in sorted(got):
        assert offset == ends.get(sequence, 0)  # gapless from 0
        ends[sequence] = offset + length
    assert max(ends.values()) <= capacity and sorted(ends) == list(range(plan.sequences))
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    if groups == 64:  # no length is rounded up
        fitted = packing.plan_packing(counts, capacity, large=1.0).sequences
        assert least <= plan.sequences <= fitted + len(counts)


def test_configurations_beat_best_fit_alone():
    counts = {51: 600, 27: 600, 26: 600, 23: 1200}  # three patterns fill every sequence; falling best fit wastes some
    plain = packing.plan_packing(counts, 100, large=1.0).sequences
    mixed = packing.plan_packing(counts, 100, groups=16, large=0.1).sequences
    assert mixed <= plain and mixed - sum(x * n for x, n in counts.items()) / 100 < 10


def test_near_the_bound_on_many_lengths():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6.4, 0.9, 200_000).astype(int) + 1, 2048)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.plan_packing(counts, 2048)
    assert plan.sequences <= 1.001 * (lengths.sum() / 2048) + 1
    assert len(plan.ranks) < 20_000


def test_documents(spark, make):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(NAME))
    rows = [*ODD, *((100 + i, "some words here " * (i % 7)) for i in range(60)), *((200 + i, t) for i, t in enumerate(HARD))]
    docs = make(rows)
    packed = packing.pack_documents(docs, NAME, 64)
    got = packed.collect()
    want = {}
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append(ids)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], bytes(r["ids"]), r["ids_crc32"]))
    assert set(by) == set(want)
    for i, pieces in by.items():
        ids, copies = want[i][0], len(want[i])
        raw = np.array(ids, "<u4").tobytes()
        assert len(pieces) == copies * -(-len(ids) // 64)
        at = 0
        for piece, start, length, part, crc in sorted(pieces)[::copies]:
            assert start == at and part == raw[4 * at : 4 * (at + length)] and crc == zlib.crc32(part) and (length == 64 or piece == 0)
            at += length
        assert at == len(ids)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in got:
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert sum(map(len, whole.values())) == 4 * sum(r["length"] for r in got) and max(map(len, whole.values())) <= 256
    assert packing.pack_documents(make([]), NAME).count() == 0
    named = make([(1, "a b")]).selectExpr("'k' AS doc_id", "text")
    assert [(r["doc_id"], r["length"]) for r in packing.pack_documents(named, NAME).collect()] == [("k", 3)]
