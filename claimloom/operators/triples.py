"""Records to triples: every template of a table in one scan, one distinct at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OWL, RDF, RDFS, SDO, Config
from ..functions.text import language_name, md5_id
from ..schemas import TRIPLES
from .ingest import without

COLUMNS = [c.split()[0] for c in TRIPLES.split(", ")]


def _triple(s: Column, p: str, o: Column, kind: str = "iri", datatype: str | None = None, lang: Column | None = None, s_kind: str = "iri") -> Column:
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    parts = (s, F.lit(s_kind), F.lit(p), o, F.lit(kind), F.lit(datatype) if datatype else none, lang if lang is not None else none)
    return F.struct(*[text(c).alias(n) for c, n in zip(parts, COLUMNS, strict=True)])


def _emit(rows: DataFrame, single: list[Column], many: list[Column]) -> DataFrame:
    """One generator per table; triples without subject or object go."""
    whole = F.array(*single)
    for more in many:
        whole = F.concat(whole, F.coalesce(F.flatten(more), F.array().cast("array<struct<" + ", ".join(f"{c}: string" for c in COLUMNS) + ">>")))
    return rows.select(F.inline(F.filter(whole, lambda t: t["s"].isNotNull() & t["o"].isNotNull())))


def level_ok() -> Column:
    """No level, another language than English, or the first of the levels."""
    first = F.try_element_at("levels", F.lit(1))["level"]
    return F.col("level").isNull() | (F.col("lang") != "en") | F.coalesce(F.col("level") == first, F.lit(False))


def usable(category: Column, excluded: tuple[str, ...]) -> Column:
    return category.isNotNull() & ~F.coalesce(category.isin(list(excluded)), F.lit(False)) if excluded else category.isNotNull()


def article_triples(articles: DataFrame, config: Config) -> DataFrame:
    """The review graph of article records; tombstones (no language) give nothing."""
    ns = lambda c: F.concat(F.lit(config.namespace), c)
    review = lambda url: ns(md5_id(url, "claimreview_"))
    said = lambda name: F.coalesce(F.col(name), F.lit("None")) if config.null_literals == "none_string" else F.col(name)
    rows = without(articles, "url", config.ignore_urls).where(F.col("lang").isNotNull()).where(level_ok())
    lang, url = F.col("lang"), F.col("url")
    r, m, site = review(url), review(F.col("main_url")), F.lit(config.namespace + config.organization_id)
    rating = F.concat(F.lit("_:rating_"), F.md5(url.cast("binary")))
    person = ns(md5_id(F.col("author"), "person_"))
    concept = F.when(usable(F.col("category"), config.exclude_ids), ns(F.col("category")))
    literal = lambda s, p, o, **k: _triple(s, p, o, "literal", **k)
    single = [
        _triple(r, RDF + "type", F.lit(SDO + "ClaimReview")),
        literal(r, SDO + "url", url, datatype=SDO + "URL"),
        _triple(r, SDO + "reviewRating", rating, "bnode"),
        _triple(rating, RDF + "type", F.lit(SDO + "Rating"), s_kind="bnode"),
        *[literal(rating, SDO + p, F.lit(v), datatype=SDO + "Number", s_kind="bnode") for p, v in (("ratingValue", "0"), ("bestRating", "1"), ("worstRating", "0"))],
        literal(rating, SDO + "ratingExplanation", said("what_the_science_says"), lang=lang, s_kind="bnode"),
        literal(rating, SDO + "name", F.lit("False"), datatype=SDO + "Text", s_kind="bnode"),
        literal(r, SDO + "dateCreated", F.date_format("last_update", "yyyy-MM-dd'T'HH:mm:ss"), datatype=SDO + "Date"),
        literal(r, SDO + "inLanguage", language_name(lang), datatype=SDO + "Text"),
        _triple(r, SDO + "author", person),
        _triple(F.when(F.col("author").isNotNull(), person), RDF + "type", F.lit(SDO + "Person")),
        literal(person, SDO + "name", F.col("author"), datatype=SDO + "Text"),
        _triple(r, SDO + "publisher", site),
        _triple(site, RDF + "type", F.lit(SDO + "Organization")),
        literal(site, SDO + "name", F.lit(config.publisher_name), lang=lang),
        literal(site, SDO + "url", F.lit(config.publisher_url), datatype=SDO + "URL"),
        literal(r, SDO + "license", F.lit(config.license_url), datatype=SDO + "URL"),
        literal(r, SDO + "description", F.col("description"), lang=lang),
        literal(r, SDO + "abstract", F.col("at_glance"), lang=lang),
        _triple(r, SDO + "about", concept),
        _triple(concept, SDO + "subjectOf", r),
        literal(r, SDO + "name", said("title"), lang=lang),
        literal(r, SDO + "headline", said("what_the_science_says"), lang=lang),
        literal(r, SDO + "reviewBody", F.col("content"), lang=lang),
        literal(r, SDO + "text", F.col("content"), lang=lang),
        _triple(r, OWL + "sameAs", F.when(F.col("main_url") != url, m)),
        _triple(r, SDO + "claimReviewed", m),
        _triple(m, RDF + "type", F.lit(SDO + "Claim")),
        literal(m, SDO + "text", said("climate_myth"), lang=lang),
        literal(m, SDO + "citation", F.col("climate_myth_source.url"), datatype=SDO + "URL"),
    ]
    many = [
        F.transform("keywords", lambda k: F.array(literal(r, SDO + "keywords", k, lang=lang))),
        F.transform("related_arguments", lambda a: F.array(_triple(r, SDO + "associatedClaimReview", review(a["url"])), _triple(r, RDFS + "seeAlso", review(a["url"])))),
        F.transform(
            "languages",
            lambda x: F.array(
                _triple(ns(x["code"]), RDF + "type", F.when(x["code"].isNotNull(), F.lit(SDO + "Language"))),
                literal(ns(x["code"]), SDO + "alternateName", x["code"], datatype=SDO + "Text"),
                literal(ns(x["code"]), SDO + "name", x["lang"], lang=lang),
            ),
        ),
    ]
    return _emit(rows, single, many)


def mapping_triples(mappings: DataFrame, config: Config) -> DataFrame:
    """Claims and their concepts, both ways."""
    concept = F.when(usable(F.col("category"), config.exclude_ids), F.concat(F.lit(config.namespace), F.col("category")))
    return _emit(mappings, [_triple(F.col("url"), SDO + "about", concept), _triple(concept, SDO + "subjectOf", F.col("url"))], [])


def graph(*parts: DataFrame) -> DataFrame:
    """Union of triples as a set: one distinct over all of them."""
    union = parts[0].select(*COLUMNS)
    for more in parts[1:]:
        union = union.unionByName(more.select(*COLUMNS))
    return union.distinct()


def build(articles: DataFrame, mappings: DataFrame | None, taxonomy: DataFrame | None, config: Config) -> DataFrame:
    parts = [article_triples(articles, config)]
    if taxonomy is not None:
        parts.append(taxonomy)
    if mappings is not None:
        parts.append(mapping_triples(mappings, config))
    return graph(*parts)


def tombstones(articles: DataFrame) -> int:
    """Records that give no triples because the page had no rebuttal."""
    return articles.where(F.col("lang").isNull()).count()
