"""Phrase collocations: word sequences that occur together more often than their parts would.

Each shard of documents becomes one array of word ids, and prefix doubling in numpy sorts its
suffixes by their first words.  Runs of neighbours whose common prefix has n words or more
are the LCP intervals of depth n: one run is one n-gram and its length the count.  The counts
of all shards are merged by (language, phrase).

Single words and pairs are counted first.  A longer phrase can only be frequent if both phrases
of one word less in it are, so further passes send on only what meets a sieve: a bit table of
fixed size over hashes of the frequent phrases.  A bit that is set by chance lets a rare phrase
through, to be counted and dropped; no frequent one is lost, however many there are.

Defined cases: a null text is empty; a null language is ``und``; texts of any length are read
whole, a piece of text is never cut between shards; rows that repeat an id each count; ties
in score go by count, then phrase; an empty table gives no phrase; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, sliced, write_table

_CASE = bytes(x + 32 if 0x41 <= x <= 0x5A else 0x0A if x in b".,;:!?\n\x0b\x0c\r" else 0x20 if x == 0x09 else x for x in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Ids of the words of one language in one shard: 0 ends a piece, -1 is no word."""

    def __init__(self, words: list[bytes]):
        super().__init__({b"": -1, b"\n": 0})
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self.words)
        self.words.append(word)
        return out


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` in the order of the suffixes there by their first ``depth`` ids or more: prefix doubling."""
    rank, length = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while length < depth:
        after = np.zeros_like(rank)
        after[:-length] = rank[length:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        steps = np.empty(len(order), np.int64)
        steps[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) if len(order) else []
        rank, length = steps, 2 * length
    return order


def intervals(ids: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, a place of each distinct n-gram within pieces, its count) for n up to ``depth``."""
    order = suffix_order(ids, depth)
    ends = np.flatnonzero(ids == 0)
    left = np.append(ends, len(ids))[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))  # words to the piece's end
    same = np.ones(max(0, len(order) - 1), bool)
    padded = np.append(ids, np.zeros(depth, ids.dtype))
    for n in range(1, depth + 1):
        same &= padded[order[1:] + n - 1] == padded[order[:-1] + n - 1]
        whole = left[order] >= n
        starts = np.flatnonzero(whole & np.append(True, ~same)[: len(order)])
        total = np.append(0, np.cumsum(whole))
        yield n, order[starts], np.diff(np.append(total[starts], total[-1]))


def _phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    out = words[0].copy()
    for w in words[1:]:
        out = (out ^ (out >> np.uint64(29))) * _MIX + w
    return out ^ (out >> np.uint64(31))


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang))


class _Shard:
    def __init__(self):
        self.langs: dict[str, Vocabulary] = {}
        self.texts: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.texts:
            self.texts[lang] = []
        vocabulary = self.langs.setdefault(lang, Vocabulary([b"\n"]))
        chunks = text.translate(_CASE).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(vocabulary.__getitem__, chunks), np.int32, len(chunks))
        ids = np.append(ids[ids >= 0], np.int32(0))
        self.texts[lang].append(ids)
        self.size += len(ids)

    def counted(self, depths: range, sieve: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """(lang, words, phrase, n): n-grams of ``depths`` words; with 0 words and no phrase, all words of a language."""
        for lang, texts in self.texts.items():
            ids, words = np.concatenate(texts), pa.array(self.langs[lang].words, pa.binary())
            if sieve is not None:
                hashes = np.fromiter((_word_hash(lang, w) for w in self.langs[lang].words), np.uint64, len(words))
            else:
                yield _rows(lang, 0, pa.nulls(1, pa.binary()), np.array([np.count_nonzero(ids)]))
            for n, at, count in intervals(ids, depths[-1]):
                if n not in depths:
                    continue
                if sieve is not None:
                    for k in (0, 1):
                        pick = _phrase_hash([hashes[ids[at + k + j]] for j in range(n - 1)])
                        at, count = (x[_met(sieve, pick)] for x in (at, count))
                if len(at):
                    parts = [words.take(pa.array(ids[at + j])) for j in range(n)]
                    yield _rows(lang, n, pc.binary_join_element_wise(*parts, b" ") if n > 1 else parts[0], count)


def _rows(lang: str, n: int, phrases: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    size = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(size, np.int32))), pa.array(np.full(size, n, np.int32)), phrases.cast(pa.string()), pa.array(count.astype(np.int64))], ["lang", "words", "phrase", "n"])


def _met(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(sieve) - 1)
    return (sieve[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _count(docs: DataFrame, depths: range, sieve: np.ndarray | None, shard_words: int) -> DataFrame:
    held = None if sieve is None else docs.sparkSession.sparkContext.broadcast(sieve)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bits = _Shard(), None if held is None else held.value
        for batch in sliced(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                shard.add(lang, text)
                if shard.size >= shard_words:
                    yield from shard.counted(depths, bits)
                    shard = _Shard()
        yield from shard.counted(depths, bits)

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, words int, phrase string, n long")
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def _sieve(frequent: DataFrame, bits: int) -> np.ndarray:
    """A table of ``bits`` bits: those of the phrases' hashes are set.  It comes to the driver in at most bits / 64 rows."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at.append(_phrase_hash([np.array([_word_hash(lang, w)], np.uint64) for w in phrase.encode().split(b" ")])[0] & np.uint64(bits - 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(at, np.int64) >> 6), pa.array(np.array(at, np.int64) & 63)], ["word", "bit"])

    set_bits = frequent.select("lang", "phrase").mapInArrow(places, "word long, bit long")
    rows = set_bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit AS int))")).alias("set")).collect()
    out = np.zeros(bits // 64, "<i8")
    out[[r[0] for r in rows]] = [r[1] for r in rows]
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, scratch: Scratch, *, min_count: int = 10, most_words: int = 3, lang_col: str = "lang", text_col: str = "text", shard_words: int = 2_000_000, sieve_bits: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``most_words`` words with at least ``min_count`` occurrences (lang, words, phrase, n), and each language's number of words.

    ``docs`` is read ``most_words`` - 1 times.
    """
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = scratch.write(_count(base, range(1, min(2, most_words) + 1), None, shard_words).where((F.col("n") >= min_count) | (F.col("words") == 0)), "phrases")
    out = [found.where("words > 0")]
    for n in range(3, most_words + 1):
        sieve = _sieve(out[-1].where(F.col("words") == n - 1), sieve_bits)
        out.append(scratch.write(_count(base, range(n, n + 1), sieve, shard_words).where(F.col("n") >= min_count), f"phrases-{n}"))
    counts = out[0]
    for more in out[1:]:
        counts = counts.unionByName(more)
    return counts, found.where("words = 0").groupBy("lang").agg(F.sum("n").alias("total"))


def mine_phrases(docs: DataFrame, *, min_count: int = 10, most_words: int = 3, share: int = 50, top: int = 2000, salts: int = 32, lang_col: str = "lang", text_col: str = "text", shard_words: int = 2_000_000, sieve_bits: int = 1 << 26) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``most_words`` words with a >= ``min_count`` occurrences is cut in two
    where floor(10**6 * a * a / (l * r)) is least, l and r being the counts of its parts.  A
    phrase goes if a longer one that holds it has ``share`` per cent of its occurrences or
    more.  Arithmetic is in whole decimals, exact for counts below 10**16.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        counts, totals = phrase_counts(docs, scratch, min_count=min_count, most_words=most_words, lang_col=lang_col, text_col=text_col, shard_words=shard_words, sieve_bits=sieve_bits)
        words = F.split("phrase", " ")
        candidates = counts.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
        piece = lambda first, size: F.array_join(F.slice(words, first, size), " ")
        held = [candidates.where(F.col("words") == n).select("lang", F.explode(F.array(*[piece(i + 1, m) for m in range(2, n) for i in range(n - m + 1)])).alias("phrase"), F.col("a").alias("longer")) for n in range(3, most_words + 1)]
        kept = candidates
        if held:
            inside = held[0]
            for more in held[1:]:
                inside = inside.unionByName(more)
            inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
            kept = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
        cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        cuts = cuts.select("lang", "phrase", "a", "k", piece(1, F.col("k")).alias("first"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
        part = counts.select("lang", "phrase", "n")
        cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        cuts = cuts.withColumn("score", F.expr("(cast(a AS decimal(16,0)) * cast(a AS decimal(16,0)) * 1000000) div (cast(l AS decimal(16,0)) * cast(r AS decimal(16,0)))"))
        scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        # the best of each share of a language first, so that no task gets a whole language
        scored = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        best, _ = write_table(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), "best-phrases")
    finally:
        scratch.drop()
    return best
