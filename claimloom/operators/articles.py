"""Pages to article records, anchors and link hierarchies.

The page is parsed once, in an Arrow batch function; everything after that is columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LANGUAGE_NAMES
from ..schemas import ARTICLE, HIERARCHY, NOT_TRANSLATED
from .dom import Node, tree

_CODES = {v.lower(): k for k, v in LANGUAGE_NAMES.items()}
_LEVELS = ("Basic", "Intermediate", "Advanced")
_VIEW = "View this argument in "


def _clean(html_text: str) -> str:
    return re.sub("<.*?>", "", html_text)


def _fold(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKD", text)


def _meta(doc: Node, name: str) -> str | None:
    return next((_clean(n.attrs["content"]) for n in doc.select("meta") if n.attrs.get("name") == name and "content" in n.attrs), None)


#: How the pages word dates and authors.
_UPDATED, _BY, _TRANSLATED_BY = r"Last updated on (\d{1,2} \w+ \d{4})", r"by ([\w\s]+)\.", r"Translation by ([A-Za-z\s]+)"


def _found(pattern: str, text: str) -> str | None:
    got = re.search(pattern, text)
    return got[1].strip() if got else None


def _byline(doc: Node):
    """(last update, author): the first green box that tells either, and for an author it lacks the footnote under the first comment."""
    date = author = None
    for box in doc.select("p.greenbox"):
        text = box.text()
        if "Last updated" in text or "Translation by" in text:
            author = _found(_BY, text)
            try:
                date = datetime.strptime(_found(_UPDATED, text) or "", "%d %B %Y").date() if "Last updated" in text else None
            except ValueError:
                date = None
            break
    comment = doc.first("div.comment") if author is None else None
    note = next((n for n in comment.after() if n.tag == "p" and n.attrs.get("class") == "footnote padding"), None) if comment else None
    return date, author if note is None else _found(_TRANSLATED_BY, note.text())


def _languages(doc: Node, url: str) -> list[dict]:
    out = []
    for a in doc.select("#centerColumn p a"):
        title = a.attrs.get("title", "")
        if title.startswith(_VIEW):
            name = title[len(_VIEW) :].strip()
            out.append({"lang": name, "url": urljoin(url, a.attrs.get("href", "")), "code": _CODES.get(name.lower())})
    return out


def _levels(doc: Node, url: str):
    """(own level, levels) if the page offers levels at all."""
    own, levels = None, []
    row = doc.first("#mainbody tr") if "Select a level..." in doc.text() else None
    for cell in [n for n in row.walk() if n.tag in ("td", "th")] if row else []:
        name = cell.text().strip()
        if name not in _LEVELS:
            continue
        level, link = name.lower(), cell.find("a")
        if link is not None:
            levels.append({"level": level, "urls": [urljoin(url, link.attrs.get("href", ""))]})
        else:
            own, other = level, url.replace(".htm", f"-{level}.htm")
            levels.append({"level": level, "urls": [url] if other == url else [url, other]})
    return own, levels


def _myth(doc: Node):
    """(text, source) of the myth box, or else of the first comment; a source is a link with a target."""
    for selector in (".comment.myth", ".comment"):
        if (box := doc.first(selector)) is not None:
            a = box.find("a")
            linked = a is not None and a.attrs.get("href") is not None
            return _fold(box.text().strip()), {"url": a.attrs["href"], "name": a.text().strip()} if linked else None, box, selector
    return None, None, None, None


def _until(nodes: list[Node], stop: str) -> list[Node]:
    out = []
    for n in nodes:
        if stop in n.classes:
            break
        out.append(n)
    return out


def _body(doc: Node, glance: str | None, says: str | None, box: Node | None, selector: str | None) -> list[Node]:
    """The elements that make up the article's text; only a page that says nothing itself is read under its first ``h4``."""
    headings = {n.text().strip(): n for n in reversed(doc.select("h2"))}
    if glance:
        details = next((n for n in doc.walk() if n.attrs.get("id") == "FurtherDetails"), None)
        if details is not None and details.parent is not None:
            return details.parent.after()
        return headings["Further details"].after() if "Further details" in headings else []
    if says:
        near = None if box is None else box.next() if selector == ".comment.myth" else box.next("div")
        if near is None and selector == ".comment.myth":  # nothing after the myth: as without it
            first = doc.first("div.comment")
            near = first.next("div") if first is not None else None
        return near.select("p") if near is not None else []
    first = doc.find("h4")
    return first.after() if first is not None else []


def _fold_body(nodes: list[Node]):
    """(text, figures): a picture takes its own text as caption, or else the next element, which is then used up."""
    lines, figures, skip = [], [], False
    for k, n in enumerate(nodes):
        if "greenbox" in n.classes:
            break
        if skip:
            skip = False
            continue
        image = n.find("img")
        text = n.text().strip()
        if image is not None:
            if not text and k + 1 < len(nodes):
                text, skip = nodes[k + 1].text().strip(), True
            figures.append({"src": image.attrs.get("src"), "alt": image.attrs.get("alt") or None, "caption": _fold(_clean(text)) or None})
        elif text:
            lines.append(text)
    return _fold("\n".join(lines).strip()), figures


def parse_article(url: str, html: str | None) -> dict:
    """The record of a main article; a page without rebuttal gives a tombstone: the URL and nulls."""
    doc = tree(html)
    if "Rebuttal not found" in doc.text():
        return {"url": url}
    title, keywords = doc.find("title"), _meta(doc, "keywords")
    date, author = _byline(doc)
    own, levels = _levels(doc, url)
    heading = doc.first("#mainbody h2")
    said = heading.next("div") if heading is not None else None
    says = said.text().strip() if said is not None else None
    myth, source, box, selector = _myth(doc) if says else (None, None, None, None)
    glance_head = next((n for n in doc.select("h2") if n.text().strip() == "At a glance"), None)
    glance = "\n".join(n.text().strip() for n in _until(glance_head.after(), "bluebox")).strip() if glance_head is not None else None
    content, figures = _fold_body(_body(doc, glance, says, box, selector))
    related_head = next((n for n in doc.select("h2") if n.text().strip() == "Related Arguments"), None)
    related_box = related_head.parent.next("div") if related_head is not None and related_head.parent is not None else None
    return {
        "url": url,
        "main_url": url,
        "level": own,
        "lang": "en",
        "title": title.text() if title is not None else None,
        "keywords": keywords.split(", ") if keywords else None,
        "description": _meta(doc, "description"),
        "author": author,
        "last_update": date,
        "languages": _languages(doc, url),
        "levels": levels,
        "what_the_science_says": says,
        "climate_myth": myth,
        "climate_myth_source": source,
        "at_glance": glance,
        "content": content,
        "figures": figures,
        "related_arguments": [{"url": urljoin(url, a.attrs.get("href", "")), "title": a.text().strip()} for a in (related_box.select("a") if related_box is not None else [])],
    }


_FIELDS = [f.split()[0] for f in re.split(r", (?=[a-z_]+ (?:string|array|struct|date))", re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", ARTICLE))]


def parse_pages(pages: DataFrame) -> DataFrame:
    """(url, html) to article records; pages are parsed where they lie, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse_article(u, h) for u, h in zip(batch["url"], batch["html"], strict=True)]
            yield pd.DataFrame([{f: r.get(f) for f in _FIELDS} for r in rows], columns=_FIELDS, dtype=object)

    return pages.select("url", "html").mapInPandas(run, ARTICLE)


def tombstone() -> Column:
    return F.col("lang").isNull()


def as_translated(articles: DataFrame, lang: Column | None = None) -> DataFrame:
    """The overlay for translated pages: fields of the main article go, the language is the
    given one or that of the entry with the page's own URL, the main URL that of the last English entry."""
    own = F.try_element_at(F.filter("languages", lambda x: x["url"] == F.col("url")), F.lit(-1))["code"]
    english = F.try_element_at(F.filter("languages", lambda x: x["code"] == "en"), F.lit(-1))["url"]
    kinds = dict(articles.dtypes)
    found = F.coalesce(lang, own, F.col("lang")) if lang is not None else F.coalesce(own, F.col("lang"))
    out = articles.withColumns({c: F.lit(None).cast(kinds[c]) for c in NOT_TRANSLATED})
    return out.withColumns({"main_url": F.when(tombstone(), F.col("main_url")).otherwise(F.coalesce(english, F.col("main_url"))), "lang": F.when(tombstone(), F.col("lang")).otherwise(found)})


def anchors(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, ord, href): the quoted links of regular markup, natively."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("ord", "href"))


def anchors_in(pages: DataFrame, selector: str) -> DataFrame:
    """(url, ord, href): links under a selector, absolute, by the document tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, html in zip(batch["url"], batch["html"], strict=True):
                links = [a for top in tree(html).select(selector) for a in ([top] if top.tag == "a" else top.select("a"))]
                rows += [(url, k, urljoin(url, a.attrs["href"])) for k, a in enumerate(x for x in links if x.attrs.get("href"))]
            yield pd.DataFrame(rows, columns=["url", "ord", "href"])

    return pages.select("url", "html").mapInPandas(run, "url string, ord int, href string")


def hierarchy(pages: DataFrame, selector: str = "#mainbody > ul", base: str | None = None) -> DataFrame:
    """The nested lists of links, flattened: page_id, node_id, parent_id, depth, ord, url."""

    def rows_of(page: str, html: str) -> list[tuple]:
        rows: list[tuple] = []

        def visit(ul: Node, parent: int | None, depth: int) -> None:
            for k, li in enumerate(c for c in ul.children if isinstance(c, Node) and c.tag == "li"):
                a = li.find("a")
                node = len(rows)
                href = a.attrs.get("href") if a is not None else None
                rows.append((page, node, parent, depth, k, urljoin(base, href) if base and href else href))
                for sub in (c for c in li.children if isinstance(c, Node) and c.tag == "ul"):
                    visit(sub, node, depth + 1)

        top = tree(html).first(selector)
        if top is not None:
            visit(top, None, 0)
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for u, h in zip(batch["url"], batch["html"], strict=True) for r in rows_of(u, h)]
            yield pd.DataFrame(rows, columns=["page_id", "node_id", "parent_id", "depth", "ord", "url"]).astype({"parent_id": "Int32"})

    return pages.select("url", "html").mapInPandas(run, HIERARCHY)
