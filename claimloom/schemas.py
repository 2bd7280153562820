"""Schemas of the stored tables.

``category_state`` keeps apart what a nullable column cannot: ``absent`` (never
classified), ``reset`` (looked at, no category) and ``set``.
"""

from __future__ import annotations

ARTICLE = (
    "url string, main_url string, level string, lang string, title string, keywords array<string>, description string, author string, last_update date, "
    "languages array<struct<lang: string, url: string, code: string>>, levels array<struct<level: string, urls: array<string>>>, what_the_science_says string, "
    "climate_myth string, climate_myth_source struct<url: string, name: string>, at_glance string, content string, "
    "figures array<struct<src: string, alt: string, caption: string>>, related_arguments array<struct<url: string, title: string>>"
)
ARTICLES = f"{ARTICLE}, category string, category_state string"
MAPPINGS = "url string, date_published string, claim string, lang string, category string, category_state string"
CLAIMS = "rev string, date_published string, text string"
TAXONOMY = "id string, url string, label string, parent_id string"
TRIPLES = "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"
PAGES = "url string, html string"
CACHE = "url_hash string, content string, fetched_at timestamp"
HIERARCHY = "page_id string, node_id int, parent_id int, depth int, ord int, url string"
#: What a translated article does not have of its own.
NOT_TRANSLATED = ("keywords", "level", "description", "last_update", "levels", "related_arguments")
