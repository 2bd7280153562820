"""Languages by ranked character trigrams.

A profile is the most frequent trigrams of a language by rank, a table of ``size`` rows for each.
A text takes the language whose profile ranks the distinct trigrams of the text highest.  Words
are padded with a blank, so beginnings and ends count.  A text without letters has no language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexicon import words_of

SIZE = 400


def _of_word(word: Column) -> Column:
    """The trigrams around each letter of a word between blanks."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.concat(F.lit(" "), word, F.lit(" ")), i, F.lit(3)))


def profiles(texts: DataFrame, text: str, lang: str, size: int = SIZE) -> DataFrame:
    """(lang, gram, weight): the first of a language's trigrams weighs ``size``, the last 1.

    Words are counted before they are cut.
    """
    known = texts.where(F.col(lang).isNotNull())
    words = known.select(F.col(lang).alias("lang"), F.explode(words_of(F.col(text))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = words.select("lang", "n", F.explode(_of_word(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", (F.lit(size + 1) - F.col("rank")).cast("long").alias("weight"))


def languages(texts: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """(key, detected) of every text; keys are unique, ties go to the first language by name.

    The profile table meets the distinct trigrams of a text; only sums per language are shuffled.
    """
    grams = texts.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct(words_of(F.col(text))), _of_word)))).alias("gram"))
    votes = grams.join(table, "gram").groupBy("key", "lang").agg(F.sum("weight").alias("score"))
    best = votes.groupBy("key").agg(F.min_by("lang", F.struct(-F.col("score"), F.col("lang"))).alias("detected"))
    return texts.select(F.col(key).alias("key")).join(best, "key", "left")
