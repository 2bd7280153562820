"""Line dedup: lines that many documents share go, except in the last document that holds them.

Lines are exploded to hashes of their keys and their places, the distinct documents of each
hash are counted, and documents that hold a repeated line are put together again by position.

Defined cases: a null or empty text is one empty line; texts of any length are read whole;
a row with a null id neither counts as a holder nor loses lines; rows with the same id count
as one document, and each loses its own lines; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_table, hash128, sized, write_table

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, kept_text.

    A line whose key has ``min_chars`` code points or more and lies in ``min_docs``
    documents or more stays only in the document with the largest id among them.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = F.transform(_lines(F.col("text")), line_key)
    placed = base.where(F.col("id").isNotNull()).select("id", F.xxhash64("text").alias("th"), F.posexplode(keys).alias("at", "key")).where(F.length("key") >= min_chars)
    h1, h2 = hash128(F.col("key"))
    held = placed.select("id", "th", "at", h1.alias("h1"), h2.alias("h2"))
    repeated = (
        held.select("id", "h1", "h2")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "last")
    )
    repeated, repeated_path = write_table(repeated, "repeated-lines")
    losing = held.join(sized(repeated, repeated_path), ["h1", "h2"]).where(F.col("id") != F.col("last"))
    losing = losing.groupBy("id", "th").agg(F.collect_set("at").alias("drops"))
    losing, path = write_table(losing, "losing-lines")
    drop_table(docs.sparkSession, repeated_path)
    losing = sized(losing.select(F.col("id").alias("l_id"), F.col("th").alias("l_th"), "drops"), path)
    joined = base.withColumn("th", F.xxhash64("text")).join(losing, (F.col("id") == F.col("l_id")) & (F.col("th") == F.col("l_th")), "left").withColumn("lines", _lines(F.col("text")))
    # places are compared by hash, so this takes time in proportion to the lines
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    return joined.select("id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept")).select(
        F.col("id").alias(id_col),
        "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )
