"""Pages over HTTP with a cache table, and remote SPARQL endpoints as a data source."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.ingest import cache_split

#: The claims that ``collect`` asks a remote endpoint for, in the endpoint's terms.
CLAIM_QUERY = """
PREFIX schema: <http://schema.org/>
SELECT DISTINCT ?rev ?date_published ?text WHERE {{
  ?rev a schema:ClaimReview ; schema:inLanguage "{language}" ; schema:datePublished ?date_published ; schema:itemReviewed ?cl .
  ?cl schema:text ?text . }}
ORDER BY DESC(?date_published) LIMIT {limit}
"""


def claim_query(language: str = "English", limit: int = 100) -> str:
    return CLAIM_QUERY.format(language=language, limit=limit)


def http_get(url: str, timeout: float = 30.0) -> tuple[int, str]:
    with urlopen(Request(url, headers={"User-Agent": "claimloom"}), timeout=timeout) as r:  # noqa: S310
        return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str]] = http_get) -> DataFrame:
    """(url, status, content, error): one request per row, errors as rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    status, content = get(url)
                    rows.append((url, status, content if status == 200 else None, None if status == 200 else f"status {status}"))
                except Exception as e:  # noqa: BLE001  the row carries it
                    rows.append((url, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "status", "content", "error"]).astype({"status": "Int32"})

    return urls.select("url").mapInPandas(run, "url string, status int, content string, error string")


def pages(urls: DataFrame, cache: DataFrame, now: datetime, expiry_s: int = 3600, get: Callable[[str], tuple[int, str]] = http_get, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pages, new cache rows): fresh cache entries first, requests for the rest.

    ``strict`` raises at a page that did not come; otherwise it is left out.
    """
    hits, misses = cache_split(urls, cache, F.lit(now), expiry_s)
    got = fetch(misses, get)
    if strict:
        bad = F.raise_error(F.concat(F.col("url"), F.lit(": "), F.col("error"))).cast("string")
        got = got.withColumn("content", F.when(F.col("error").isNotNull(), bad).otherwise(F.col("content")))
    got = got.where("content IS NOT NULL").select("url", "content")
    found = hits.select("url", "content").unionByName(got).select("url", F.col("content").alias("html"))
    return found, got.select(F.md5(F.col("url").cast("binary")).alias("url_hash"), "content", F.lit(now).alias("fetched_at"))


def binding_rows(text: str, names: list[str]) -> list[tuple]:
    """Rows of a SPARQL JSON result; none if it is not one."""
    try:
        rows = json.loads(text)["results"]["bindings"]
        return [tuple(r.get(n, {}).get("value") for n in names) for r in rows]
    except (ValueError, KeyError, TypeError, AttributeError):
        return []


class SparqlSource(DataSource):
    """``spark.read.format("sparql").option("endpoint", ...).option("query", ...).option("variables", "a,b")``."""

    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> str:
        return ", ".join(f"{n} string" for n in self.options["variables"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return _SparqlReader(dict(self.options))


class _SparqlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition):
        url = self.options["endpoint"] + "?" + urlencode({"query": self.options["query"], "format": "application/sparql-results+json"})
        request = Request(url, headers={"Accept": "application/sparql-results+json", "User-Agent": "claimloom"})
        with urlopen(request, timeout=float(self.options.get("timeout", "60"))) as r:  # noqa: S310
            yield from binding_rows(r.read().decode(), self.options["variables"].split(","))


def remote_select(spark: SparkSession, endpoint: str, query: str, variables: list[str]) -> DataFrame:
    spark.dataSource.register(SparqlSource)
    return spark.read.format("sparql").options(endpoint=endpoint, query=query, variables=",".join(variables)).load()
