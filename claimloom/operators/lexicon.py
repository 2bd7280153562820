"""A lexicon learnt from a corpus: base forms of words, and words that are names.

Base forms come from suffix edits: an ending of up to four letters gives way to one of at most
one, as in ``-ies`` to ``-y``.  An edit is learnt where many stems stand in the corpus with both
endings, and where most words with the ending have such a base.  A word takes its longest edit
whose base is a word itself.  Names are words that stand capitalised inside sentences.

Everything is a join on stems or words: an ending meets at most as many bases as the alphabet has
letters, so no stem, however rich, gives pairs by its square.  Vocabularies are counted with
map-side sums before any shuffle.  Null texts have no words; ties go to the edit with more
stems, then to the shorter, then to the alphabetically first base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS

#: English words for numbers.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion "
    "first second third fourth fifth sixth seventh eighth ninth tenth"
).split()


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}]+)"), F.lit(1))


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """(word, n): lower-case words of letters and their occurrences."""
    return texts.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _cuts(words: DataFrame, longest: int, shortest: int) -> DataFrame:
    """(word, stem, ending) for endings of 0 to ``longest`` letters after stems of ``shortest`` or more."""
    cut = words.select("word", F.explode(F.sequence(F.lit(0), F.lit(longest))).alias("k")).where(F.length("word") - F.col("k") >= shortest)
    size = F.length("word") - F.col("k")
    return cut.select("word", F.substring("word", F.lit(1), size).alias("stem"), F.substring("word", size + 1, F.col("k")).alias("ending"))


def suffix_edits(words: DataFrame, *, stems: int = 5, share: float = 0.3, longest: int = 4, shortest: int = 3) -> DataFrame:
    """(ending, base_ending, stems): edits with at least ``stems`` stems, which are ``share`` of the ending's or more."""
    cuts = _cuts(words, longest, shortest)
    forms = cuts.where(F.length("ending") >= 1)
    bases = cuts.where(F.length("ending") <= 1).select("stem", F.col("ending").alias("base_ending"))
    pairs = forms.join(bases, "stem").where(F.length("ending") > F.length("base_ending"))
    found = pairs.groupBy("ending", "base_ending").agg(F.count(F.lit(1)).alias("stems")).where(F.col("stems") >= stems)
    every = forms.groupBy("ending").agg(F.count(F.lit(1)).alias("all"))
    return found.join(every, "ending").where(F.col("stems") >= share * F.col("all")).select("ending", "base_ending", "stems")


def lemmas(words: DataFrame, edits: DataFrame, *, longest: int = 4, shortest: int = 3) -> DataFrame:
    """(word, lemma) of the words that have another base form; the rest stand for themselves."""
    forms = _cuts(words, longest, shortest).where(F.length("ending") >= 1).join(edits, "ending")
    forms = forms.select("word", "ending", "base_ending", "stems", F.concat("stem", "base_ending").alias("lemma"))
    known = forms.join(words.select(F.col("word").alias("lemma")), "lemma", "left_semi")
    first = F.min_by("lemma", F.struct(-F.length("ending"), -F.col("stems"), F.length("base_ending"), F.col("base_ending")))
    return known.groupBy("word").agg(first.alias("lemma"))


def proper_nouns(texts: DataFrame, text: str, *, least: int = 3, share: float = 0.8) -> DataFrame:
    """(word, n_capital, n_small) of words that inside sentences are capitalised ``least`` times and in ``share`` of all cases.

    Inside a sentence is what follows a letter, a comma or a semicolon and one blank.  Words in
    capitals alone say nothing.
    """
    inside = texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?<=[\p{L},;] )([\p{L}]+)"), F.lit(1))).alias("w"))
    first, rest = F.substring("w", 1, 1), F.substring("w", 2, 1 << 30)
    capital = (first != F.lower(first)) & (rest == F.lower(rest))
    small = F.col("w") == F.lower("w")
    counted = inside.groupBy(F.lower("w").alias("word")).agg(F.count_if(capital).alias("n_capital"), F.count_if(small).alias("n_small"))
    return counted.where((F.col("n_capital") >= least) & (F.col("n_capital") >= share * (F.col("n_capital") + F.col("n_small"))))


def lemma_tokens(texts: DataFrame, key: str, text: str, lemma_table: DataFrame, names: DataFrame, stop: list[str] | tuple[str, ...] = (*STOP_WORDS, *NUMBER_WORDS)) -> DataFrame:
    """(key, token): distinct base forms of each text without stop words, number words and names."""
    kept = F.array_except(words_of(F.col(text)), F.array(*[F.lit(w) for w in stop]).cast("array<string>"))
    rows = texts.select(F.col(key).alias("key"), F.explode(kept).alias("word")).join(names.select("word"), "word", "left_anti")
    rows = rows.join(lemma_table, "word", "left")
    return rows.select("key", F.coalesce("lemma", "word").alias("token")).distinct()


def clean_texts(texts: DataFrame, key: str, text: str, lemma_table: DataFrame, names: DataFrame) -> DataFrame:
    """(key, tokens), the tokens in order; texts that have none keep an empty list.  Keys are unique."""
    gathered = lemma_tokens(texts, key, text, lemma_table, names).groupBy("key").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    there = texts.select(F.col(key).alias("key")).join(gathered, "key", "left")
    return there.select("key", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
