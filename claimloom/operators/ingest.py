"""Ingestion: anti-join insert, first row per key, keyed merge, crawl frontier, page cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detect_language, md5_id, non_blank
from .language import languages


def not_stored(rows: DataFrame, stored: DataFrame, key: str, stored_key: str | None = None) -> DataFrame:
    """Rows whose key is not stored yet."""
    there = stored.select(F.col(stored_key or key).alias("_stored")).distinct()
    return rows.join(there, rows[key] == there["_stored"], "left_anti")


def without(rows: DataFrame, column: str, ignored: list[str] | tuple[str, ...]) -> DataFrame:
    """Rows whose value is not on a list; nulls stay."""
    return rows.where(~F.coalesce(F.col(column).isin(list(ignored)), F.lit(False))) if ignored else rows


def first_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key: one aggregate with map-side combine, no sort of whole groups.

    Ties go to the smallest row of all columns.
    """
    names = rows.columns
    ordered = [F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])] if order else []
    best = F.min_by(F.struct(*names), F.struct(*ordered, *names)).alias("row")
    return rows.groupBy(F.col(key).alias("_key")).agg(best).select("row.*")


def last_per_key(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last write of each key in one crawl."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.struct(sequence, *[c for c in rows.columns if c != sequence])).alias("row")).select("row.*")


def new_mappings(claims: DataFrame, mappings: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Claims to insert: not stored, not blank, the newest row of each URL, with a detected language.

    ``profiles`` (of ``language.profiles``) tells languages by trigrams; without it frequent words of seven do.
    """
    fresh = not_stored(claims.where(non_blank(F.col("text")) & F.col("rev").isNotNull()), mappings, "rev", "url")
    first = last_per_key(fresh, "rev", "date_published")
    lang = detect_language(F.col("text"))
    if profiles is not None:
        first = first.join(languages(first, "rev", "text", profiles).withColumnRenamed("key", "rev"), "rev")
        lang = F.col("detected")
    return first.select(
        F.col("rev").alias("url"),
        "date_published",
        F.col("text").alias("claim"),
        lang.alias("lang"),
        F.lit(None).cast("string").alias("category"),
        F.lit("absent").alias("category_state"),
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: str, keep: tuple[str, ...] = ("category",), state: str = "category_state") -> DataFrame:
    """Merge by key: incoming columns win, ``keep`` columns and their state survive unless given anew.

    ``incoming`` may lack columns; those keep the stored value, as keys that a record
    does not carry.  One full outer join, one shuffle of each side by the key.
    """
    old, new = stored.alias("old"), incoming.alias("new")
    have = set(incoming.columns)
    picked = []
    for c in stored.columns:
        a, b = F.col(f"old.{c}"), F.col(f"new.{c}") if c in have else None
        if c == key:
            picked.append(F.coalesce(b, a).alias(c))
        elif b is None:
            value = F.when(F.col(f"old.{key}").isNull(), F.lit("absent")).otherwise(a) if c == state else a
            picked.append(value.alias(c))
        elif c in keep or c == state:
            given = F.coalesce(F.col(f"new.{state}") != "absent", F.lit(False)) if state in have else b.isNotNull()
            picked.append(F.when(F.col(f"new.{key}").isNull() | (~given & F.col(f"old.{key}").isNotNull()), a).otherwise(b).alias(c))
        else:
            picked.append(F.when(F.col(f"new.{key}").isNotNull(), b).otherwise(a).alias(c))
    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(*picked)


def set_category(rows: DataFrame, lang: str | None = None) -> Column:
    """Whether a row awaits classification: its key is absent and its language is the asked one, if any is asked."""
    waits = F.col("category_state") == "absent"
    return waits & (F.col("lang") == lang) if lang else waits


def frontier(articles: DataFrame) -> DataFrame:
    """(url, kind, lang): pages one hop from the given articles, those of other levels and of other languages."""
    levels = articles.select(F.explode("levels").alias("l")).select(F.explode("l.urls").alias("url"), F.lit("level").alias("kind"), F.lit("en").alias("lang"))
    languages = articles.select(F.explode("languages").alias("l")).select(F.col("l.url").alias("url"), F.lit("language").alias("kind"), F.col("l.code").alias("lang")).where("lang IS NULL OR lang <> 'en'")
    return levels.unionByName(languages).where("url IS NOT NULL").distinct()


def discovered(*lists: DataFrame, ignored: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Union of URL lists, without repeats and ignored ones, in order."""
    union = lists[0].select("url")
    for more in lists[1:]:
        union = union.unionByName(more.select("url"))
    return without(union.distinct(), "url", ignored).orderBy("url")


def cache_split(urls: DataFrame, cache: DataFrame, now: Column, expiry_s: int) -> tuple[DataFrame, DataFrame]:
    """(hits with content, URLs to fetch): an entry counts while it is younger than the expiry."""
    young = cache.where(F.col("fetched_at") > now - F.make_dt_interval(secs=F.lit(float(expiry_s)))).select("url_hash", "content")
    young = young.groupBy("url_hash").agg(F.max("content").alias("content"))
    keyed = urls.select("url").distinct().withColumn("url_hash", md5_id(F.col("url")))
    return keyed.join(young, "url_hash").select("url", "url_hash", "content"), keyed.join(young, "url_hash", "left_anti").select("url", "url_hash")
