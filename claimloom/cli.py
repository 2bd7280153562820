"""Commands: collect, process, build, classify, stats, query, serve."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from datetime import UTC, datetime
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import Config
from .operators import classify as matching
from .operators import concepts, crawl, ingest, stats, triples
from .plans.sparql import query as sparql
from .schemas import ARTICLES, CLAIMS, MAPPINGS
from .session import session
from .sources import rdf, store, web


def matcher(labels: DataFrame, least: float) -> Callable[[DataFrame, str], DataFrame]:
    """Gives (key, category) of rows (url, text column) by the most similar label, the taxonomy's first on ties."""
    return lambda rows, text: matching.best_match(rows, labels, "url", text, "id", "label", "ord", least).select("key", "category")


def model(name: str, window: int) -> Callable[[DataFrame, str], DataFrame]:
    """The same by the two models of a module that has loaders ``binary`` and ``classes`` (``classify.two_stage``)."""
    module = import_module(name)
    return lambda rows, text: matching.two_stage(rows, text, module.binary, module.classes, window).select(F.col("url").alias("key"), "category")


def classify_rows(rows: DataFrame, categories: Callable[[DataFrame, str], DataFrame], text: str, lang: str | None = "en", reset_others: bool = False) -> DataFrame:
    """Sets the category of rows with a text that await it; ``reset_others`` takes it from rows of another language."""
    waits = F.coalesce(ingest.set_category(rows, lang), F.lit(False)) & F.col(text).isNotNull()
    found = categories(rows.where(waits).select("url", text), text).select("key", F.col("category").alias("_found"))
    out = rows.join(found, rows["url"] == found["key"], "left")
    foreign = (F.col("category_state") != "absent") & ~F.coalesce(F.col("lang") == lang, F.lit(False)) if reset_others else F.lit(False)
    state = F.when(F.col("_found").isNotNull(), "set").when(foreign, "reset").otherwise(F.col("category_state"))
    return out.withColumns({"category": F.when(~foreign, F.coalesce("_found", "category")), "category_state": state}).select(*rows.columns)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimloom", description=__doc__)
    parser.add_argument("--version", "-v", action="version", version=__version__)
    sub = parser.add_subparsers(dest="command")
    c = sub.add_parser("collect", help="crawl articles with their levels and languages, and ask a remote endpoint for claims")
    c.add_argument("urls", nargs="?", help="a text file of article URLs")
    c.add_argument("--index", nargs=2, action="append", default=[], metavar=("URL", "SELECTOR"), help="a page that lists articles, and where")
    c.add_argument("--cache", default=None)
    c.add_argument("--pages", help="where to write the crawled pages")
    c.add_argument("--endpoint", help="a SPARQL endpoint that has claims")
    c.add_argument("--claims", help="where to write the claims, as JSON lines")
    c.add_argument("--lenient", action="store_true", help="leave out pages that do not come")
    c = sub.add_parser("process", help="parse pages and claims into the stored tables")
    c.add_argument("pages")
    c.add_argument("--claims")
    c.add_argument("--taxonomy", help="a Turtle file, or \"builtin\"")
    c.add_argument("--models", help="a module with the loaders of the two models, instead of matching labels")
    c.add_argument("--articles-db", default=None)
    c.add_argument("--mappings-db", default=None)
    c = sub.add_parser("build", help="build the graph")
    c.add_argument("--articles-db", default=None)
    c.add_argument("--mappings-db", default=None)
    c.add_argument("--taxonomy")
    c.add_argument("--output", default="graph")
    c.add_argument("--format", default="ttl", choices=["ttl", "nt", "nq", "xml", "json-ld"])
    c = sub.add_parser("classify", help="match one text to a taxonomy")
    c.add_argument("text")
    c.add_argument("--taxonomy", default="builtin")
    c.add_argument("--models")
    c = sub.add_parser("stats", help="value counts of a stored table")
    c.add_argument("path")
    c.add_argument("--key", default="category")
    for name in ("query", "serve"):
        c = sub.add_parser(name)
        c.add_argument("--rdf", default="graph")
        c.add_argument("--rdf-format", default="ttl")
        if name == "query":
            c.add_argument("text")
        else:
            c.add_argument("--host", default="127.0.0.1")
            c.add_argument("--port", type=int, default=8000)
    args = parser.parse_args(argv)
    if not args.command:
        parser.print_help()
        return 0
    config, spark = Config.from_env(), spark or session()
    if args.command == "collect":
        collect(spark, config, args)
    elif args.command == "process":
        path = args.articles_db or config.articles_path
        parsed = crawl.records(ingest.without(spark.read.parquet(args.pages), "url", config.ignore_urls))
        parsed = parsed.withColumns({"category": F.lit(None).cast("string"), "category_state": F.lit("absent")})
        merged = ingest.upsert(store.stored(spark, path, ARTICLES), parsed, "url")
        categories = _categories(spark, config, args)
        store.replace(classify_rows(merged, categories, "climate_myth", reset_others=True) if categories else merged, path)
        if args.claims:
            path = args.mappings_db or config.mappings_path
            rows = ingest.new_mappings(spark.read.schema(CLAIMS).json(args.claims), store.stored(spark, path, MAPPINGS))
            (classify_rows(rows, categories, "claim") if categories else rows).write.mode("append").parquet(path)
    elif args.command == "build":
        taxonomy = _taxonomy(spark, config, args.taxonomy) if args.taxonomy else None
        graph = triples.build(store.stored(spark, args.articles_db or config.articles_path, ARTICLES), store.stored(spark, args.mappings_db or config.mappings_path, MAPPINGS), taxonomy, config)
        rdf.write_rdf(graph, args.output, args.format, config.prefixes, config.namespace)
    elif args.command == "classify":
        found = _categories(spark, config, args)(spark.createDataFrame([("", args.text)], "url string, t string"), "t")
        print(found.select(matching.plain_category(F.col("category"))).first()[0])
    elif args.command == "stats":
        counts = stats.value_counts(spark.read.parquet(args.path), args.key)
        counts.orderBy(F.desc("n")).show(truncate=False)
        stats.summary(counts).show()
    else:
        graph = rdf.read_rdf(spark, args.rdf, args.rdf_format)
        prefixes = {"": config.namespace} | config.prefixes
        if args.command == "query":
            found = sparql(graph, args.text, prefixes).persist()
            found.show(found.count(), truncate=False)
        else:
            from .serve import server

            server(graph.persist(), config, args.host, args.port).serve_forever()
    return 0


def _taxonomy(spark: SparkSession, config: Config, name: str) -> DataFrame:
    return concepts.concept_triples(spark, config.namespace) if name == "builtin" else rdf.read_rdf(spark, name, "ttl")


def _categories(spark: SparkSession, config: Config, args) -> Callable[[DataFrame, str], DataFrame] | None:
    if args.models:
        return model(args.models, config.text_window)
    return matcher(matching.taxonomy(_taxonomy(spark, config, args.taxonomy)), config.min_similarity) if args.taxonomy else None


def collect(spark: SparkSession, config: Config, args, get: Callable[[str], tuple[int, str]] = web.http_get) -> None:
    cache, now = args.cache or config.cache_path, datetime.now(UTC).replace(tzinfo=None)
    fetch = lambda urls: crawl.cached(urls, cache, now, config.cache_expiry_s, get, strict=not args.lenient)
    lists = [spark.read.text(args.urls).select(F.col("value").alias("url"))] if args.urls else []
    if args.index:
        lists.append(crawl.index_urls(spark, args.index, config.ignore_urls, fetch))
    if lists:
        pages = crawl.crawl(ingest.discovered(*lists, ignored=config.ignore_urls), fetch)
        store.replace(pages, args.pages or f"{cache}_pages")
        store.remove(spark, f"{cache}_asked")
    if args.endpoint:
        found = web.remote_select(spark, args.endpoint, web.claim_query(limit=config.claim_limit), ["rev", "date_published", "text"])
        found.write.mode("overwrite").json(args.claims or "claims")


if __name__ == "__main__":
    sys.exit(main())
