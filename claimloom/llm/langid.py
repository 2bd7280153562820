"""Language ID by cross-parsing entropy.

For each language a suffix automaton holds labelled text.  A document is cut greedily
into the longest matches with that text; a match that fails starts the next phrase.
Each phrase costs log2 of the length of the labelled text, for where it is, and log2 of
the alphabet, for the symbol that ends it; the language with the fewest bits per symbol
wins.  Symbols are the bytes of the lower-cased letters in UTF-8, so that every letter of
every script is told apart, with a blank for each run of anything else.

Texts are parsed whole, blocks of 256 symbols side by side with numpy: the automata are
tables, and one step of all blocks is one lookup.  A block starts where the one before it
ended, inside a phrase or not: blocks whose start was guessed wrong are parsed again until
all starts hold, so the phrases are those of a parse from end to end.

The fit is bounded to ``symbols_per_lang`` symbols of a language, in whole documents: of
about twice ``docs_per_lang`` labelled documents, chosen by hash, those that fit are taken
in the order of the hash until the bound is met; longer ones are left out.  Where all are
longer, a stretch of the first of them is taken, at a place given by its hash.  An id that
is repeated gives one text.

Defined cases: a null or empty text or one without a letter gets ``und`` and score 0,
and so does every text if there is no labelled document; a language whose labelled texts
hold no letter is not learnt; ties go to the language with more documents, then to the
smaller name; repeated rows are each answered, with ids of any type or null; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, sliced

BLOCK = 256
_BLANK, _PAD = 0, 1
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Of each code point: 2 a letter, 1 a mark that goes with letters, 0 anything else."""
    if not _letters:
        kinds = np.zeros(0x110000, np.uint8)
        for code in range(0x110000):
            kinds[code] = 2 if (c := chr(code)).isalpha() else unicodedata.category(c)[0] == "M"
        _letters.append(kinds)
    return _letters[0]


def letters(text: str) -> tuple[bytes, bool]:
    """(UTF-8 of the lower-cased letters, one blank for each run of others; whether there is a letter)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kinds = letter_table()[codes]
    codes = np.where(kinds > 0, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep].tobytes().decode("utf-32-le").encode(), bool((kinds == 2).any())


class LanguageParser:
    """Automata of several languages as tables of moves."""

    def __init__(self, texts: dict[str, str], shares: dict[str, int], most: int):
        own = {k: letters(t)[0][:most] for k, t in texts.items()}
        self.langs = sorted(own, key=lambda k: (-shares.get(k, 0), k))
        seen = sorted({x for t in own.values() for x in t} - {32})
        # bytes that no labelled text has match nothing anywhere: they share the last symbol
        self.width = len(seen) + 3
        self.symbol = np.full(256, self.width - 1, np.uint8)
        self.symbol[seen], self.symbol[32] = np.arange(2, len(seen) + 2), _BLANK
        self.start = []
        self.moves, self.bits = [], []
        for lang in self.langs:
            self.moves.append(self._table(self.symbols(own[lang]).tolist()))
            self.start.append(len(self.moves[-1]) // self.width - 1)
            self.bits.append(np.log2(len(own[lang]) + 2) + np.log2(self.width))

    def symbols(self, text: bytes) -> np.ndarray:
        return self.symbol[np.frombuffer(text, np.uint8)]

    def _table(self, text: list[int]) -> np.ndarray:
        """Moves of the suffix automaton: 2 * width * next state, plus 1 where a phrase begins.

        The last state is the one between phrases: every symbol begins one there, and a
        symbol that the text lacks leads back to it.
        """
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and c not in step[at]:
                step[at][c] = new
                at = link[at]
            if at >= 0:
                there = step[at][c]
                if length[there] == length[at] + 1:
                    link[new] = there
                else:
                    split = len(step)
                    step.append(dict(step[there]))
                    link.append(link[there])
                    length.append(length[at] + 1)
                    link[there] = link[new] = split
                    while at >= 0 and step[at].get(c) == there:
                        step[at][c] = split
                        at = link[at]
            last = new
        between = len(step)
        begin = np.full(self.width, between, np.int32)
        for c, there in step[0].items():
            begin[c] = there
        moves = np.tile(begin * 2 * self.width + 1, (len(step) + 1, 1))
        for state, own in enumerate(step):
            for c, there in own.items():
                moves[state, c] = there * 2 * self.width
        moves[:, _PAD] = np.arange(len(step) + 1) * 2 * self.width
        return moves.ravel()

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases of each text in each language."""
        own = [self.symbols(t) for t in texts]
        sizes = np.array([len(x) for x in own])
        blocks = np.maximum(1, -(-sizes // BLOCK))
        first = np.cumsum(blocks) - blocks
        flat = np.full(int(blocks.sum()) * BLOCK, _PAD, np.uint8)
        for x, at in zip(own, first * BLOCK, strict=True):
            flat[at : at + len(x)] = x
        steps = np.ascontiguousarray(flat.reshape(-1, BLOCK).T)
        inner = np.ones(steps.shape[1], bool)
        inner[first] = False
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, (moves, start) in enumerate(zip(self.moves, self.start, strict=True)):
            entry = np.full(steps.shape[1], start * self.width, np.int32)
            count, end = self._parse(moves, steps, entry)
            open_ = np.flatnonzero(inner)
            while len(open_):  # blocks that began elsewhere than the block before them ended
                open_ = open_[entry[open_] != end[open_ - 1]]
                entry[open_] = end[open_ - 1]
                count[open_], end[open_] = self._parse(moves, steps[:, open_], entry[open_])
                open_ = open_[open_ + 1 < len(inner)] + 1
                open_ = open_[inner[open_]]
            out[:, k] = np.add.reduceat(count, first)
        return out

    @staticmethod
    def _parse(moves: np.ndarray, steps: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state, count = entry.copy(), np.zeros(steps.shape[1], np.int64)
        for symbols in steps:
            state += symbols
            got = moves[state]
            count += got & 1
            state = got >> 1
        return count, state

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Bits per symbol of each text and language."""
        return self.phrases(texts) * np.array(self.bits) / np.maximum([len(t) for t in texts], 1)[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; the score falls with the bits that other languages come near."""
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        start = 0
        while start < len(texts):
            stop, size, own, lettered = start, 0, [], []
            while stop < len(texts) and (stop == start or size + len(texts[stop]) < 4_000_000):
                size += len(texts[stop])
                x, has = letters(texts[stop])
                own.append(x)
                lettered.append(has)
                stop += 1
            cost = self.costs(own)
            total = cost * np.maximum([len(x) for x in own], 1)[:, None] / max(self.bits)
            best = cost.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(total.min(axis=1, keepdims=True) - total, -50)).sum(axis=1)
            for i in np.flatnonzero(lettered):
                langs[start + i], scores[start + i] = self.langs[best[i]], share[i]
            start = stop
        return langs, scores


def fit_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 64, symbols_per_lang: int = 32_000, mod: int = 4, held: int = 2) -> LanguageParser:
    """Learn from documents with a language whose crc32(id) mod ``mod`` is not ``held``."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known = known.where(remainder(F.col("id"), mod) != held).withColumn("fits", F.octet_length("text") <= symbols_per_lang)
    shares = {r["lang"]: (r["n"], r["fit"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("fit")).collect()}  # one row per language
    if not shares:
        return LanguageParser({}, {}, symbols_per_lang)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for k, (n, fit) in shares.items() for x in (k, min(1.0, 2 * docs_per_lang / (fit or n)))])
    fitting = F.create_map(*[F.lit(x) for k, (_, fit) in shares.items() for x in (k, fit > 0)])
    drawn = known.where((draw < rate[F.col("lang")]) & (F.col("fits") == fitting[F.col("lang")]))
    place = (F.pmod(F.xxhash64("id", F.lit(1)), F.length("text") - symbols_per_lang // 4 + 1) + 1).cast("int")
    text = F.when(F.col("fits"), F.col("text")).otherwise(F.substring("text", place, F.lit(symbols_per_lang // 4)))
    # an id gives one text, the smallest, however often it is repeated: about 2 * docs_per_lang of a language come here
    rows = drawn.select("lang", draw.alias("draw"), "id", text.alias("text")).groupBy("lang", "draw", "id").agg(F.min("text").alias("text")).collect()
    texts: dict[str, str] = {}
    for lang in sorted(shares):
        size, own = 0, []
        for _, _, text in sorted((r["draw"], str(r["id"]), r["text"]) for r in rows if r["lang"] == lang):
            more = len(text.encode("utf-8", "replace")) + 1
            if size + more <= symbols_per_lang + 1:
                own.append(text)
                size += more
        texts[lang] = "\n".join(own)
    return LanguageParser({k: t for k, t in texts.items() if letters(t)[1]}, {k: n for k, (n, _) in shares.items()}, symbols_per_lang)


def identify_languages(docs: DataFrame, parser: LanguageParser, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            langs, scores = parser.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"`{id_col}` {base.schema['id'].dataType.simpleString()}, lang_pred string, score double")
