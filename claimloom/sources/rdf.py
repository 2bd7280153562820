"""RDF files: N-Triples and N-Quads natively by line, Turtle and other syntaxes a file at a time, and all but TriG written."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import RDF, XSD
from ..schemas import TRIPLES

_IRI, _TERM = r"<([^<>]*)>", r"(?:<[^<>]*>|_:[^\s]+)"
#: What stands in quotes.  Possessive, so that the JVM walks along it; a plain repetition of the two
#: alternatives calls itself for each character and ends on the stack of long literals.
_BODY = r'(?:[^"\\]++|\\[\s\S])*+'
#: The groups of a statement: subject, predicate, object unless a literal, body, language and datatype of a literal, graph.
_LINE = rf'^\s*({_TERM})\s+{_IRI}\s+(?:({_TERM})|"({_BODY})"(?:@([A-Za-z0-9-]+)|\^\^<([^<>]*)>)?)(?:\s+({_TERM}))?\s*\.\s*(?:#.*)?$'
_GROUPS = 7
_NOTHING = r"^\s*(?:#.*)?$"


def _has_code(c: Column) -> Column:
    return F.contains(c, F.lit("\\u")) | F.contains(c, F.lit("\\U"))


def _coded(c: Column) -> Column:
    """Without the escapes of single characters by their code."""

    def plain(x: Column) -> Column:
        short = F.concat(F.decode(F.unhex(F.substring(x, 3, 4)), "UTF-16BE"), F.substring(x, 7, 1 << 30))
        long_ = F.concat(F.decode(F.unhex(F.substring(x, 3, 8)), "UTF-32"), F.substring(x, 11, 1 << 30))
        return F.when(F.regexp_like(x, F.lit(r"^\\u[0-9A-Fa-f]{4}")), short).when(F.regexp_like(x, F.lit(r"^\\U[0-9A-Fa-f]{8}")), long_).otherwise(x)

    return F.when(_has_code(c), F.array_join(F.transform(F.split(c, r"(?=\\[uU])"), plain), "")).otherwise(c)


def _unescape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\\\"), F.lit("\0"))
    for short, whole in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
        out = F.replace(out, F.lit(short), F.lit(whole))
    back = lambda x: F.replace(x, F.lit("\0"), F.lit("\\"))
    return F.when(_has_code(c), back(_coded(out))).when(F.contains(c, F.lit("\\")), back(out)).otherwise(c)


def _escape(c: Column) -> Column:
    for whole, short in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')):
        c = F.replace(c, F.lit(whole), F.lit(short))
    return c


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of an N-Triples or N-Quads file that are neither a statement nor a comment."""
    return spark.read.text(path).where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(_NOTHING))


def read_nquads(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Triples and their graph ``g``.  Splittable, JVM only; a bad line raises an error under ``strict``, else see ``bad_lines``."""
    # each line meets the pattern once: its groups come as lines of their own, which no line holds, and a line that
    # is no statement stays as it is; the generator keeps filters and columns from repeating the match
    groups = F.regexp_replace("value", _LINE + r"[\s\S]*", "\n".join(f"${k + 1}" for k in range(_GROUPS)))
    lines = spark.read.text(path).select(F.explode(F.array(F.split(groups, "\n", -1))).alias("x"))
    said = F.size("x") == _GROUPS
    if strict:
        told = F.raise_error(F.concat(F.lit("no statement: "), F.col("x")[0])).cast("boolean")
        said = F.when(said, True).when(F.col("x")[0].rlike(_NOTHING), False).otherwise(told)
    s, p, o, body, lang, datatype, g = (F.col("x")[k] for k in range(_GROUPS))
    bare = lambda c: F.when(c.startswith("<"), _coded(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)
    literal = o == ""
    datatype = F.nullif(F.nullif(datatype, F.lit("")), F.lit(XSD + "string"))
    kind = lambda c: F.when(c.startswith("<"), "iri").otherwise("bnode")
    return lines.where(said).select(
        bare(s).alias("s"),
        kind(s).alias("s_kind"),
        _coded(p).alias("p"),
        F.when(literal, _unescape(body)).otherwise(bare(o)).alias("o"),
        F.when(literal, "literal").otherwise(kind(o)).alias("o_kind"),
        F.when(literal, _coded(datatype)).alias("o_datatype"),
        F.when(literal, F.nullif(lang, F.lit(""))).alias("o_lang"),
        F.nullif(bare(g), F.lit("")).alias("g"),
    )


def read_ntriples(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return read_nquads(spark, path, strict).drop("g")


def _term(value: Column, kind: Column) -> Column:
    return F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).otherwise(value)


def object_term() -> Column:
    mark = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).otherwise("")
    return F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), _escape(F.col("o")), F.lit('"'), mark)).otherwise(_term(F.col("o"), F.col("o_kind")))


def ntriples(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat(_term(F.col("s"), F.col("s_kind")), F.lit(" <"), F.col("p"), F.lit("> "), object_term(), F.lit(" .")).alias("value"))


def write_nquads(quads: DataFrame, path: str, mode: str = "overwrite") -> None:
    graph = F.when(F.col("g").isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), F.when(F.col("g").startswith("_:"), F.col("g")).otherwise(F.concat(F.lit("<"), F.col("g"), F.lit(">")))))
    quads.select(F.concat(_term(F.col("s"), F.col("s_kind")), F.lit(" <"), F.col("p"), F.lit("> "), object_term(), graph, F.lit(" .")).alias("value")).write.mode(mode).text(path)


def write_ntriples(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    ntriples(triples).write.mode(mode).text(path)


def turtle(triples: DataFrame, prefixes: dict[str, str], namespace: str = "") -> DataFrame:
    """(ord, value): the header, then one block per subject with its predicates in order."""
    known = ({"": namespace} if namespace else {}) | prefixes

    def short(c: Column, kind: Column) -> Column:
        out = _term(c, kind)
        for name, base in known.items():
            local = F.substring(c, len(base) + 1, 1 << 30)
            out = F.when((kind == "iri") & c.startswith(base) & F.regexp_like(local, F.lit("^[A-Za-z0-9_][A-Za-z0-9_-]*$")), F.concat(F.lit(f"{name}:"), local)).otherwise(out)
        return out

    iri = F.lit("iri")
    predicate = F.when(F.col("p") == RDF + "type", "a").otherwise(short(F.col("p"), iri))
    mark = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^"), short(F.col("o_datatype"), iri))).otherwise("")
    value = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), _escape(F.col("o")), F.lit('"'), mark)).otherwise(short(F.col("o"), F.col("o_kind")))
    pairs = triples.select(short(F.col("s"), F.col("s_kind")).alias("subject"), F.concat(predicate, F.lit(" "), value).alias("pair"))
    blocks = pairs.groupBy("subject").agg(F.sort_array(F.collect_set("pair")).alias("pairs"))
    body = blocks.select(F.lit(1).alias("ord"), F.concat(F.col("subject"), F.lit(" "), F.array_join("pairs", " ;\n    "), F.lit(" .\n")).alias("value"))
    head = "\n".join(f"@prefix {n}: <{b}> ." for n, b in known.items()) + "\n"
    return triples.sparkSession.createDataFrame([(0, head)], "ord int, value string").unionByName(body)


#: A graph with more bytes of terms is written in several files, which are read apart.
FILE_BYTES = 2 << 20


def _texts(triples: DataFrame, rows: DataFrame, path: str, files: int | None = None) -> None:
    """(ord, value) as whole texts: each has the first and last rows and whole subjects, in order.

    Without a number of files they are as many as keep each small.  Blank nodes may stand in several files of one
    write; ``read_files`` knows them by the name that these share.
    """
    if files is None:
        size = triples.agg(F.sum(F.octet_length("s") + F.octet_length("p") + F.octet_length("o"))).first()[0]
        files = -(-(size or 0) // FILE_BYTES)
    if files <= 1:
        rows.orderBy("ord", "value").select("value").coalesce(1).write.mode("overwrite").text(path)
        return
    body = rows.where("ord = 1").withColumn("file", F.pmod(F.xxhash64("value"), F.lit(files)))
    ends = rows.where("ord <> 1").crossJoin(rows.sparkSession.range(files).withColumnRenamed("id", "file"))
    parts = ends.unionByName(body).repartition(files, "file").sortWithinPartitions("file", "ord", "value")
    parts.select("file", "value").write.mode("overwrite").partitionBy("file").text(path)


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str], namespace: str = "", files: int | None = None) -> None:
    """Turtle in one file, or in several that have the prefixes and whole subjects; large graphs in as many as needed."""
    _texts(triples, turtle(triples, prefixes, namespace), path, files)


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<bnode>_:[\w.-]*[\w-])
    |(?P<name>[A-Za-z_][\w.-]*(?<!\.)?:(?:[\w%-](?:[\w.%:-]*[\w%:-])?)?|:(?:[\w%-](?:[\w.%:-]*[\w%:-])?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\](){}])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", '"': '"', "'": "'", "\\": "\\", "b": "\b", "f": "\f"}


def unquote(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.DOTALL)


class TurtleParser:
    """Turtle with prefixes, base, lists of predicates and objects, literals, blank nodes and collections."""

    def __init__(self, text: str, scope: str = "", own: str | None = None):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no Turtle at {text[at : at + 40]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.scope, self.own, self.count, self.out = 0, {}, "", scope, scope if own is None else own, 0, []

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None):
        token = self.peek()
        if value is not None and token[1] != value:
            raise ValueError(f"expected {value!r}, found {token[1]!r}")
        self.at += 1
        return token

    def blank(self) -> tuple:
        self.count += 1
        return (f"_:b{self.own}{self.count}", "bnode", None, None)

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text.lower() in ("@prefix", "prefix", "@base", "base"):
                self.directive()
            else:
                subject = self.term()
                if self.peek()[1] != ".":
                    self.predicates(subject)
                self.take(".")
        return self.out

    def directive(self) -> None:
        text = self.take()[1]
        if text.lower().endswith("prefix"):
            name, iri = self.take()[1], self.take()[1]
            self.prefixes[name.rstrip(":")] = urljoin(self.base, iri[1:-1]) if self.base else iri[1:-1]
        else:
            self.base = self.take()[1][1:-1]
        if text[0] == "@":
            self.take(".")

    def predicates(self, subject: tuple) -> None:
        while True:
            if self.peek() == ("word", "a"):
                self.take()
                predicate = RDF + "type"
            else:
                predicate = self.term()[0]
            while True:
                value = self.term()
                self.out.append((subject[0], subject[1], predicate, *value))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", "}") or self.peek()[0] == "end":
                return
            if self.tokens[self.at - 1][1] != ";":
                raise ValueError(f"expected ';' or '.', found {self.peek()[1]!r}")

    def term(self) -> tuple:
        kind, text = self.take()
        if kind == "iri":
            return (urljoin(self.base, text[1:-1]) if self.base else text[1:-1], "iri", None, None)
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return (self.prefixes[prefix] + local, "iri", None, None)
        if kind == "bnode":
            return (f"_:{self.scope}{text[2:]}", "bnode", None, None)
        if kind in ("string", "long"):
            value = unquote(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "at":
                return (value, "literal", None, self.take()[1][1:])
            if self.peek()[0] == "type":
                self.take()
                datatype = self.term()[0]
                return (value, "literal", None if datatype == XSD + "string" else datatype, None)
            return (value, "literal", None, None)
        if kind == "number":
            return (text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None)
        if kind == "word" and text in ("true", "false"):
            return (text, "literal", XSD + "boolean", None)
        if text == "[":
            node = self.blank()
            if self.peek()[1] != "]":
                self.predicates(node)
            self.take("]")
            return node
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            rest = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                node = self.blank()
                self.out += [(node[0], "bnode", RDF + "first", *item), (node[0], "bnode", RDF + "rest", *rest)]
                rest = node
            return rest
        raise ValueError(f"no term: {text!r}")


def parse_turtle(text: str, scope: str = "", own: str | None = None) -> list[tuple]:
    """Labels of blank nodes are kept under ``scope``, nodes without a label are named under ``own``."""
    return TurtleParser(text, scope, own).parse()


#: A file among those that one write of a graph has made; the group is the name of the write.
_PART = re.compile(r"/file=\d+/part-\d+-([0-9a-f-]{36})[^/]*$")


def read_files(spark: SparkSession, path: str, parse, schema: str = TRIPLES) -> DataFrame:
    """Files as rows of ``parse(text, scope, own)``, a file at a time, through any store that Spark reads."""

    def run(batches):
        import hashlib

        import pandas as pd

        names = [c.split()[0] for c in schema.split(", ")]
        mark = lambda x: hashlib.md5(x.encode()).hexdigest()[:8]
        for batch in batches:
            for p, x in zip(batch["path"], batch["content"], strict=True):
                rows = parse(bytes(x).decode(), mark(_PART.sub(r"/\1", p)), mark(p))
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[k : k + 10_000], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, parse_turtle)


class TurtleSource(DataSource):
    """``spark.read.format("turtle").option("path", ...)`` for files that the executors can open."""

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return TRIPLES

    def reader(self, schema) -> DataSourceReader:
        return _TurtleReader(self.options["path"])


class _TurtleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition):
        with open(partition.value, encoding="utf-8") as f:
            yield from parse_turtle(f.read())


#: Names of syntaxes and those that they stand for.
FORMS = {"nt": "nt", "ntriples": "nt", "n-triples": "nt", "nq": "nq", "nquads": "nq", "n-quads": "nq", "ttl": "ttl", "turtle": "ttl", "trig": "trig", "xml": "xml", "rdf": "xml", "rdf/xml": "xml", "pretty-xml": "xml", "json-ld": "json-ld", "jsonld": "json-ld"}


def read_rdf(spark: SparkSession, path: str, form: str = "nt") -> DataFrame:
    """Triples of a file or folder; quads, with ``g``, of N-Quads and TriG."""
    from . import formats

    kind = FORMS.get(form.lower())
    if kind == "nt":
        return read_ntriples(spark, path, strict=True)
    if kind == "nq":
        return read_nquads(spark, path, strict=True)
    if kind in ("ttl", "xml", "json-ld"):
        return read_files(spark, path, {"ttl": parse_turtle, "xml": formats.parse_xml, "json-ld": formats.parse_jsonld}[kind])
    if kind == "trig":
        return read_files(spark, path, formats.parse_trig, f"{TRIPLES}, g string")
    raise ValueError(f"unknown RDF format: {form}")


def write_rdf(triples: DataFrame, path: str, form: str, prefixes: dict[str, str], namespace: str = "") -> None:
    from . import formats

    kind = FORMS.get(form.lower())
    if kind == "nt":
        write_ntriples(triples, path)
    elif kind == "nq":
        write_nquads(triples if "g" in triples.columns else triples.withColumn("g", F.lit(None).cast("string")), path)
    elif kind == "ttl":
        write_turtle(triples, path, prefixes, namespace)
    elif kind in ("xml", "json-ld"):
        _texts(triples, (formats.rdf_xml if kind == "xml" else formats.json_ld)(triples), path)
    else:
        raise ValueError(f"unknown RDF format to write: {form}")
