"""More RDF syntaxes: RDF/XML and JSON-LD, read a file at a time and written a subject at a time, and TriG.

Quads have a column ``g`` beside those of a triple: the graph's IRI, null for the default graph.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RDF, XSD
from .rdf import TurtleParser

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = f"{{{RDF}}}"
_SYNTAX = {"RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype", "li"}


class _Out:
    """Collects triples and names blank nodes; labels of a graph stay apart from those of others by ``scope``, nodes without one by ``own``."""

    def __init__(self, scope: str, own: str | None = None):
        self.scope, self.own, self.count, self.rows = scope, scope if own is None else own, 0, []

    def blank(self, label: str | None = None) -> tuple:
        self.count += label is None
        return (f"_:{self.scope}{label}" if label is not None else f"_:g{self.own}{self.count}", "bnode", None, None)

    def add(self, s: tuple, p: str, o: tuple) -> None:
        self.rows.append((s[0], s[1], p, *o))


def _iri(text: str, base: str) -> tuple:
    return (urljoin(base, text) if base else text, "iri", None, None)


def _literal(text: str, datatype: str | None = None, lang: str | None = None) -> tuple:
    return (text, "literal", None if lang or datatype == XSD + "string" else datatype, lang or None)


# -- RDF/XML
def parse_xml(text: str, scope: str = "", own: str | None = None, base: str = "") -> list[tuple]:
    out, root = _Out(scope, own), ET.fromstring(text)
    nodes = root if root.tag == _R + "RDF" else [root]
    base, lang = root.get(_XML + "base", base), root.get(_XML + "lang")
    for node in nodes:
        _node(node, out, base, lang)
    return out.rows


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1)


def _node(e: ET.Element, out: _Out, base: str, lang: str | None) -> tuple:
    base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
    if (about := e.get(_R + "about")) is not None:
        s = _iri(about, base)
    elif (own := e.get(_R + "ID")) is not None:
        s = _iri("#" + own, base)
    else:
        s = out.blank(e.get(_R + "nodeID"))
    if e.tag != _R + "Description":
        out.add(s, RDF + "type", _iri(_name(e.tag), ""))
    for k, v in e.attrib.items():
        if k == _R + "type":
            out.add(s, RDF + "type", _iri(v, base))
        elif not k.startswith(_XML) and not (k.startswith(_R) and k[len(_R) :] in _SYNTAX) and k.startswith("{"):
            out.add(s, _name(k), _literal(v, lang=lang))
    items = 0
    for child in e:
        items += child.tag == _R + "li"
        p = f"{RDF}_{items}" if child.tag == _R + "li" else _name(child.tag)
        out.add(s, p, _property(child, out, base, lang))
    return s


def _property(e: ET.Element, out: _Out, base: str, lang: str | None) -> tuple:
    base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
    form, inner = e.get(_R + "parseType"), list(e)
    if form == "Literal":
        whole = (e.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in inner)
        return _literal(whole, RDF + "XMLLiteral")
    if form == "Resource":
        s = out.blank()
        for child in inner:
            out.add(s, _name(child.tag), _property(child, out, base, lang))
        return s
    if form == "Collection":
        rest = (RDF + "nil", "iri", None, None)
        for item in reversed([_node(x, out, base, lang) for x in inner]):
            cell = out.blank()
            out.add(cell, RDF + "first", item)
            out.add(cell, RDF + "rest", rest)
            rest = cell
        return rest
    if inner:
        return _node(inner[0], out, base, lang)
    if (resource := e.get(_R + "resource")) is not None or e.get(_R + "nodeID") is not None:
        return _iri(resource, base) if resource is not None else out.blank(e.get(_R + "nodeID"))
    more = {k: v for k, v in e.attrib.items() if k.startswith("{") and not k.startswith(_XML) and not (k.startswith(_R) and k[len(_R) :] in _SYNTAX)}
    if more:
        s = out.blank()
        for k, v in more.items():
            out.add(s, _name(k), _literal(v, lang=lang))
        return s
    datatype = e.get(_R + "datatype")
    return _literal(e.text or "", datatype, None if datatype else lang)


# -- JSON-LD
def parse_jsonld(text: str, scope: str = "", own: str | None = None, base: str = "") -> list[tuple]:
    """Triples of a JSON-LD text with inline contexts; contexts by reference are refused."""
    out, whole = _Out(scope, own), json.loads(text)
    for node in whole if isinstance(whole, list) else [whole]:
        _object(node, {"@base": base}, out)
    return out.rows


def _context(given, context: dict) -> dict:
    for part in given if isinstance(given, list) else [given]:
        if isinstance(part, str):
            raise ValueError(f"the context {part} is not inline")
        context = dict(context) if part is not None else {"@base": context.get("@base", "")}
        for k, v in (part or {}).items():
            context[k] = v
    return context


def _expand(name: str, context: dict, vocab: bool) -> str:
    """A term or compact IRI as an IRI; keywords stay."""
    if name.startswith("@"):
        return name
    term = context.get(name)
    if vocab and term is not None:
        found = term.get("@id", name) if isinstance(term, dict) else term
        return _expand(found, {k: v for k, v in context.items() if k != name}, True) if found != name else found
    prefix, colon, local = name.partition(":")
    if colon and not local.startswith("//") and prefix in context:
        start = context[prefix]
        return _expand(start["@id"] if isinstance(start, dict) else start, {k: v for k, v in context.items() if k != prefix}, True) + local
    if colon:
        return name
    return context["@vocab"] + name if vocab and context.get("@vocab") else urljoin(context.get("@base") or "", name)


def _resource(name: str, context: dict, out: _Out, vocab: bool = False) -> tuple:
    return out.blank(name[2:]) if name.startswith("_:") else (_expand(name, context, vocab), "iri", None, None)


def _object(node: dict, context: dict, out: _Out) -> tuple:
    context = _context(node["@context"], context) if "@context" in node else context
    keys = {k: _expand(k, context, True) for k in node if k != "@context"}
    own = next((node[k] for k, v in keys.items() if v == "@id"), None)
    s = _resource(own, context, out) if own is not None else out.blank() if set(keys.values()) - {"@graph"} else None
    for k, p in keys.items():
        values = node[k] if isinstance(node[k], list) else [node[k]]
        if p == "@type":
            for v in values:
                out.add(s, RDF + "type", _resource(v, context, out, vocab=True))
        elif p == "@graph":
            for v in values:
                _object(v, context, out)
        elif p == "@reverse":
            for q, nodes in node[k].items():
                for v in nodes if isinstance(nodes, list) else [nodes]:
                    out.add(_object(v, context, out) if isinstance(v, dict) else _resource(v, context, out), _expand(q, context, True), s)
        elif not p.startswith("@") and ":" in p:
            term = context.get(k) if isinstance(context.get(k), dict) else {}
            if term.get("@container") == "@list":
                values = [{"@list": values}]
            for v in values:
                if v is not None:
                    out.add(s, p, _value(v, term, context, out))
    return s


def _value(v, term: dict, context: dict, out: _Out) -> tuple:
    if isinstance(v, dict):
        if "@value" in v:
            kind = v.get("@type")
            return _scalar(v["@value"], _expand(kind, context, True) if kind else None, v.get("@language"))
        if "@list" in v:
            rest = (RDF + "nil", "iri", None, None)
            for item in reversed([_value(x, term, context, out) for x in v["@list"]]):
                cell = out.blank()
                out.add(cell, RDF + "first", item)
                out.add(cell, RDF + "rest", rest)
                rest = cell
            return rest
        return _object(v, context, out)
    kind = term.get("@type")
    if kind in ("@id", "@vocab"):
        return _resource(v, context, out, vocab=kind == "@vocab")
    lang = term.get("@language", context.get("@language")) if isinstance(v, str) and kind is None else None
    return _scalar(v, _expand(kind, context, True) if kind else None, lang)


def _scalar(v, datatype: str | None, lang: str | None) -> tuple:
    if isinstance(v, bool):
        return _literal("true" if v else "false", datatype or XSD + "boolean")
    if isinstance(v, int):
        return _literal(str(v), datatype or XSD + "integer")
    if isinstance(v, float):
        return _literal(str(int(v)), datatype or XSD + "integer") if v.is_integer() and abs(v) < 1e21 else _literal(repr(v), datatype or XSD + "double")
    return _literal(v, datatype, lang.lower() if lang else None)


# -- TriG
class TrigParser(TurtleParser):
    """Turtle with named graphs: rows have the graph as their last value."""

    def parse(self) -> list[tuple]:
        done: list[tuple] = []
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text.lower() in ("@prefix", "prefix", "@base", "base"):
                self.directive()
                continue
            if text.lower() == "graph" and kind == "word":
                self.take()
            name = None if self.peek()[1] == "{" else self.term()
            if self.peek()[1] == "{":
                self.take("{")
                while self.peek()[1] != "}":
                    subject = self.term()
                    if self.peek()[1] not in (".", "}"):
                        self.predicates(subject)
                    if self.peek()[1] == ".":
                        self.take()
                self.take("}")
                graph = name[0] if name else None
            else:
                if self.peek()[1] != ".":
                    self.predicates(name)
                self.take(".")
                graph = None
            done += [(*t, graph) for t in self.out]
            self.out = []
        return done


def parse_trig(text: str, scope: str = "", own: str | None = None) -> list[tuple]:
    return TrigParser(text, scope, own).parse()


# -- written
def _xml_text(c: Column) -> Column:
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def rdf_xml(triples: DataFrame) -> DataFrame:
    """(ord, value): the root, one Description per subject, the end; each property brings its own namespace."""
    cut = r"^(.*[^A-Za-z0-9_.-])?([A-Za-z_][A-Za-z0-9_.-]*)$"
    space, local = F.regexp_extract("p", cut, 1), F.regexp_extract("p", cut, 2)
    bad = F.raise_error(F.concat(F.lit("no XML name at the end of "), F.col("p"))).cast("string")
    tag = F.when(local == "", bad).otherwise(F.concat(F.lit("p:"), local))
    where = F.concat(F.lit(' xmlns:p="'), _xml_text(space), F.lit('"'))
    mark = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("o_lang"), F.lit('"'))).when(F.col("o_datatype").isNotNull(), F.concat(F.lit(' rdf:datatype="'), _xml_text(F.col("o_datatype")), F.lit('"'))).otherwise("")
    link = F.when(F.col("o_kind") == "iri", F.concat(F.lit(' rdf:resource="'), _xml_text(F.col("o")), F.lit('"/>'))).otherwise(F.concat(F.lit(' rdf:nodeID="'), F.substring("o", 3, 1 << 30), F.lit('"/>')))
    text = F.concat(mark, F.lit(">"), F.replace(_xml_text(F.col("o")), F.lit("\r"), F.lit("&#13;")), F.lit("</"), tag, F.lit(">"))
    line = F.concat(F.lit("<"), tag, where, F.when(F.col("o_kind") == "literal", text).otherwise(link))
    about = F.when(F.col("s_kind") == "iri", F.concat(F.lit('rdf:about="'), _xml_text(F.col("s")), F.lit('"'))).otherwise(F.concat(F.lit('rdf:nodeID="'), F.substring("s", 3, 1 << 30), F.lit('"')))
    blocks = triples.select(about.alias("about"), line.alias("line")).groupBy("about").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    body = blocks.select(F.lit(1).alias("ord"), F.concat(F.lit("<rdf:Description "), F.col("about"), F.lit(">\n  "), F.array_join("lines", "\n  "), F.lit("\n</rdf:Description>")).alias("value"))
    ends = triples.sparkSession.createDataFrame([(0, f'<rdf:RDF xmlns:rdf="{RDF}">'), (2, "</rdf:RDF>")], "ord int, value string")
    return ends.unionByName(body)


def json_ld(triples: DataFrame) -> DataFrame:
    """(ord, value): an array of expanded nodes, one per subject and line."""
    none = F.lit(None).cast("string")
    literal = F.col("o_kind") == "literal"
    value = F.to_json(F.struct(F.when(literal, F.col("o")).alias("@value"), F.when(literal, F.col("o_datatype")).alias("@type"), F.when(literal, F.col("o_lang")).alias("@language"), F.when(literal, none).otherwise(F.col("o")).alias("@id")))
    quoted = lambda c: F.substring(F.to_json(F.struct(c.alias("x"))), 6, 1 << 30)  # noqa: E731  '"text"}' of '{"x":"text"}'
    bare = lambda c: F.expr("substring(q, 1, length(q) - 1)") if c is None else c
    rows = triples.select("s", F.col("p"), value.alias("v")).groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_set("v")), ",").alias("vs"))
    rows = rows.withColumn("q", quoted(F.col("p"))).select("s", F.concat(bare(None), F.lit(":["), F.col("vs"), F.lit("]")).alias("pair"))
    nodes = rows.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list("pair")), ",").alias("pairs")).withColumn("q", quoted(F.col("s")))
    body = nodes.select(F.lit(1).alias("ord"), F.concat(F.lit(',{"@id":'), bare(None), F.lit(","), F.col("pairs"), F.lit("}")).alias("value"))
    ends = triples.sparkSession.createDataFrame([(0, '[{"@context":{}}'), (2, "]")], "ord int, value string")
    return ends.unionByName(body)
