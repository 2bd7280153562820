"""The crawl: index pages give article URLs, articles give their other levels and languages."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CACHE, PAGES
from ..sources import store, web
from . import articles, ingest

#: How a page was found, in the order in which a crawl stores it: of one URL the last one counts.
KINDS = ("main", "level", "language")
CRAWLED = f"{PAGES}, kind string, lang string"
FAILED = "url string, status int, error string, fetched_at timestamp"


def cached(urls: DataFrame, cache_path: str, now: datetime, expiry_s: int, get: Callable[[str], tuple[int, str]], strict: bool) -> DataFrame:
    """(url, html) of pages; what the cache at ``cache_path`` lacks is fetched once and added to it.

    A page that does not come raises an error under ``strict``; else it goes to the table
    ``<cache_path>_failed`` and is left out.
    """
    spark = urls.sparkSession
    # list and pages are written: a plan that read two states of the cache would take them for one
    asked = f"{cache_path}_asked/{uuid.uuid4().hex}"
    urls.select("url").distinct().write.parquet(asked)
    urls = spark.read.schema("url string").parquet(asked)
    misses = ingest.cache_split(urls, store.stored(spark, cache_path, CACHE), F.lit(now), expiry_s)[1]
    fetched = web.fetch(misses, get).withColumn("fetched_at", F.lit(now))
    got_path = f"{cache_path}_fetched"
    fetched.write.mode("overwrite").parquet(got_path)
    got = spark.read.schema(fetched.schema).parquet(got_path)
    failed = got.where("content IS NULL")
    got.where("content IS NOT NULL").select(F.md5(F.col("url").cast("binary")).alias("url_hash"), "content", "fetched_at").write.mode("append").parquet(cache_path)
    bad = failed.select("url", "status", "error", "fetched_at")
    first = bad.orderBy("url").first()
    if first is not None:
        bad.write.mode("append").parquet(f"{cache_path}_failed")
        if strict:
            raise RuntimeError(f"{first['url']}: {first['error']}")
    hits = ingest.cache_split(urls, store.stored(spark, cache_path, CACHE), F.lit(now), expiry_s)[0]
    hits.select("url", F.col("content").alias("html")).write.parquet(f"{asked}-pages")
    return spark.read.schema(PAGES).parquet(f"{asked}-pages")


def index_urls(spark: SparkSession, index: list[tuple[str, str]], ignored: tuple[str, ...], fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The sorted, distinct links under the selector of each (index page, selector)."""
    lists = []
    for url, selector in index:
        lists.append(articles.anchors_in(fetch(spark.createDataFrame([(url,)], "url string")), selector).select(F.col("href").alias("url")))
    return ingest.discovered(*lists, ignored=ignored)


def crawl(urls: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(url, html, kind, lang) of the given pages and of those one hop from them."""
    main = fetch(urls)
    more = ingest.frontier(articles.parse_pages(main))
    found = fetch(more.select("url").distinct())
    given = main.select("url", "html", F.lit("main").alias("kind"), F.lit(None).cast("string").alias("lang"))
    return given.unionByName(more.join(found, "url").select("url", "html", "kind", F.when(F.col("kind") == "language", F.col("lang")).alias("lang")))


def records(pages: DataFrame) -> DataFrame:
    """Article records of crawled pages, one per URL: translated pages get the overlay, the last kind counts.

    ``pages`` needs ``url`` and ``html``; without ``kind`` all are main pages.
    """
    if "kind" not in pages.columns:
        pages = pages.withColumns({"kind": F.lit("main"), "lang": F.lit(None).cast("string")})
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    last = pages.groupBy("url").agg(F.max_by(F.struct("html", "kind", "lang"), F.struct(rank.alias("r"), "lang", "html")).alias("p")).select("url", "p.*")
    parts = [articles.parse_pages(last.where("kind IS NULL OR kind <> 'language'"))]
    other = last.where("kind = 'language'")
    parts += [articles.as_translated(articles.parse_pages(other).join(other.select(F.col("url").alias("_of"), F.col("lang").alias("_lang")), F.col("url") == F.col("_of")), F.col("_lang")).drop("_of", "_lang")]
    return reduce(DataFrame.unionByName, parts)
