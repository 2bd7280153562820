"""SPARQL text to an algebra of plain tuples and dataclasses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..config import RDF, XSD
from ..sources.rdf import unquote

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<var>[?$]\w+)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:\w+)
    |(?P<name>(?:[A-Za-z][\w-]*(?:\.[\w-]+)*)?:(?:[\w](?:[\w.-]*[\w-])?)?)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;*/|^+?!=<>-])""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    value: str
    kind: str  # iri, literal or bnode
    datatype: str | None = None
    lang: str | None = None


@dataclass
class Group:
    """Parts in order: ("bgp", patterns), ("filter", e), ("optional", g), ("union", [g]), ("minus", g),
    ("bind", e, name), ("values", names, rows), ("graph", term, g), ("select", Query), ("group", g)."""

    parts: list = field(default_factory=list)


@dataclass
class Query:
    form: str
    where: Group
    items: list = field(default_factory=list)  # (name, expression or None); empty: all
    distinct: bool = False
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int = 0
    template: list = field(default_factory=list)
    graphs: list = field(default_factory=list)
    values: tuple | None = None


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no SPARQL at {text[at : at + 40]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.count = 0, dict(prefixes or {}), "", 0

    # -- tokens
    def peek(self, ahead: int = 0):
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "")

    def is_(self, *words: str) -> bool:
        kind, text = self.peek()
        return text.upper() in words if kind in ("word", "mark") else False

    def take(self, *words: str):
        token = self.peek()
        if words and not self.is_(*words):
            raise ValueError(f"expected {' or '.join(words)}, found {token[1]!r}")
        self.at += 1
        return token

    def took(self, *words: str) -> bool:
        if self.is_(*words):
            self.at += 1
            return True
        return False

    # -- queries
    def parse(self) -> Query:
        self.prologue()
        if self.is_("INSERT", "DELETE", "LOAD", "CLEAR", "DROP", "CREATE", "COPY", "MOVE", "ADD", "WITH"):
            raise ValueError("updates are not supported")
        form = self.take("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")[1].upper()
        query = self.select() if form == "SELECT" else self.other(form)
        if self.peek()[0] != "end":
            raise ValueError(f"unexpected {self.peek()[1]!r}")
        return query

    def prologue(self) -> None:
        while self.is_("PREFIX", "BASE"):
            if self.take()[1].upper() == "BASE":
                self.base = self.take()[1][1:-1]
            else:
                name = self.take()[1]
                self.prefixes[name[:-1]] = self.take()[1][1:-1]

    def select(self) -> Query:
        query = Query("SELECT", Group())
        query.distinct = self.took("DISTINCT") or self.took("REDUCED")
        while not self.is_("WHERE", "{", "FROM"):
            if self.took("*"):
                break
            if self.took("("):
                e = self.expression()
                self.take("AS")
                query.items.append((self.take()[1][1:], e))
                self.take(")")
            else:
                query.items.append((self.variable(), None))
        self.dataset(query)
        self.took("WHERE")
        query.where = self.group()
        self.modifiers(query)
        return query

    def other(self, form: str) -> Query:
        query = Query(form, Group())
        if form == "CONSTRUCT" and self.is_("{"):
            self.take("{")
            query.template = self.triples()
            self.take("}")
        if form == "DESCRIBE":
            while self.peek()[0] in ("var", "iri", "name") or self.is_("*"):
                query.items.append((None, self.primary()) if not self.took("*") else ("*", None))
        self.dataset(query)
        if self.took("WHERE") or self.is_("{"):
            query.where = self.group()
            if form == "CONSTRUCT" and not query.template:
                query.template = [t for p in query.where.parts if p[0] == "bgp" for t in p[1]]
        self.modifiers(query)
        return query

    def dataset(self, query: Query) -> None:
        while self.took("FROM"):
            self.took("NAMED")
            query.graphs.append(self.term().value)

    def modifiers(self, query: Query) -> None:
        if self.took("GROUP"):
            self.take("BY")
            while not self.is_("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES", "}") and self.peek()[0] != "end":
                if self.took("("):
                    e = self.expression()
                    query.group.append((self.take()[1][1:] if self.took("AS") else None, e))
                    self.take(")")
                else:
                    query.group.append((None, self.primary()))
        if self.took("HAVING"):
            while self.is_("(") or (self.peek()[0] == "word" and not self.is_("ORDER", "LIMIT", "OFFSET", "VALUES")):
                query.having.append(self.primary())
        if self.took("ORDER"):
            self.take("BY")
            while not self.is_("LIMIT", "OFFSET", "VALUES", "}") and self.peek()[0] != "end":
                down = self.is_("DESC")
                self.took("ASC", "DESC")
                query.order.append((self.primary(), down))
        while self.is_("LIMIT", "OFFSET"):
            if self.take()[1].upper() == "LIMIT":
                query.limit = int(self.take()[1])
            else:
                query.offset = int(self.take()[1])
        if self.is_("VALUES"):
            query.values = self.values()

    # -- patterns
    def group(self) -> Group:
        self.take("{")
        out = Group()
        if self.took("SELECT"):
            out.parts.append(("select", self.select()))
            self.take("}")
            return out
        while not self.took("}"):
            if self.took("."):
                continue
            if self.took("FILTER"):
                out.parts.append(("filter", self.primary()))
            elif self.took("OPTIONAL"):
                out.parts.append(("optional", self.group()))
            elif self.took("MINUS"):
                out.parts.append(("minus", self.group()))
            elif self.took("BIND"):
                self.take("(")
                e = self.expression()
                self.take("AS")
                out.parts.append(("bind", e, self.variable()))
                self.take(")")
            elif self.is_("VALUES"):
                out.parts.append(("values", *self.values()))
            elif self.took("GRAPH"):
                where = self.node()
                out.parts.append(("graph", where, self.group()))
            elif self.is_("SERVICE"):
                raise ValueError("SERVICE is not supported")
            elif self.is_("{"):
                options = [self.group()]
                while self.took("UNION"):
                    options.append(self.group())
                out.parts.append(("union", options) if len(options) > 1 else ("group", options[0]))
            else:
                patterns = self.triples()
                if out.parts and out.parts[-1][0] == "bgp":
                    out.parts[-1][1].extend(patterns)
                else:
                    out.parts.append(("bgp", patterns))
        return out

    def values(self) -> tuple:
        self.take("VALUES")
        if self.took("("):
            names = []
            while not self.took(")"):
                names.append(self.variable())
            wide = True
        else:
            names, wide = [self.variable()], False
        rows = []
        self.take("{")
        while not self.took("}"):
            if wide:
                self.take("(")
            row = [None if self.took("UNDEF") else self.term() for _ in names]
            if wide:
                self.take(")")
            rows.append(row)
        return names, rows

    def variable(self) -> str:
        kind, text = self.take()
        if kind != "var":
            raise ValueError(f"expected a variable, found {text!r}")
        return text[1:]

    def blank(self) -> Var:
        self.count += 1
        return Var(f"_b{self.count}")

    def triples(self) -> list:
        out: list = []
        while self.peek()[0] in ("var", "iri", "name", "bnode", "string", "long", "number") or self.is_("[", "(", "TRUE", "FALSE"):
            bare = not self.is_("[")
            subject = self.node(out)
            if bare or not self.is_(".", "}"):
                self.predicates(subject, out)
            if not self.took("."):
                break
        return out

    def predicates(self, subject, out: list) -> None:
        while True:
            path = Var(self.take()[1][1:]) if self.peek()[0] == "var" else self.path()
            while True:
                out.append((subject, path, self.node(out)))
                if not self.took(","):
                    break
            while self.took(";"):
                pass
            if self.tokens[self.at - 1][1] != ";" or self.is_(".", "}", "]"):
                return

    def node(self, out: list | None = None):
        kind, text = self.peek()
        if kind == "var":
            return Var(self.take()[1][1:])
        if kind == "bnode":
            return Var("_" + self.take()[1][2:])
        if self.is_("["):
            self.take()
            node = self.blank()
            if not self.is_("]"):
                self.predicates(node, out)
            self.take("]")
            return node
        if self.is_("("):
            self.take()
            items = []
            while not self.took(")"):
                items.append(self.node(out))
            rest = Term(RDF + "nil", "iri")
            for item in reversed(items):
                node = self.blank()
                out += [(node, ("iri", RDF + "first"), item), (node, ("iri", RDF + "rest"), rest)]
                rest = node
            return rest
        return self.term()

    def iri(self, text: str) -> str:
        if text.startswith("<"):
            return text[1:-1] if re.match("[A-Za-z][A-Za-z0-9+.-]*:", text[1:]) else self.base + text[1:-1]
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + local

    def term(self) -> Term:
        kind, text = self.take()
        if kind in ("iri", "name"):
            return Term(self.iri(text), "iri")
        if kind in ("string", "long"):
            value = unquote(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "lang":
                return Term(value, "literal", None, self.take()[1][1:])
            if self.took("^^"):
                datatype = self.iri(self.take()[1])
                return Term(value, "literal", None if datatype == XSD + "string" else datatype)
            return Term(value, "literal")
        sign = ""
        if text in ("+", "-") and self.peek()[0] == "number":
            sign, (kind, text) = text, self.take()
        if kind == "number":
            return Term(sign.replace("+", "") + text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text.lower() in ("true", "false"):
            return Term(text.lower(), "literal", XSD + "boolean")
        raise ValueError(f"expected a term, found {text!r}")

    # -- property paths: ("iri", x) ("inverse", p) ("seq", a, b) ("alt", a, b) ("plus" | "star" | "maybe", p) ("not", [iris], [inverse iris])
    def path(self):
        out = self.path_sequence()
        while self.took("|"):
            out = ("alt", out, self.path_sequence())
        return out

    def path_sequence(self):
        out = self.path_step()
        while self.took("/"):
            out = ("seq", out, self.path_step())
        return out

    def path_step(self):
        inverse = self.took("^")
        if self.took("("):
            out = self.path()
            self.take(")")
        elif self.took("!"):
            out = self.path_negated()
        elif self.peek() == ("word", "a"):
            self.take()
            out = ("iri", RDF + "type")
        else:
            out = ("iri", self.term().value)
        while self.is_("+", "*", "?"):
            out = ({"+": "plus", "*": "star", "?": "maybe"}[self.take()[1]], out)
        return ("inverse", out) if inverse else out

    def path_negated(self):
        forward, backward, many = [], [], self.took("(")
        while True:
            into = backward if self.took("^") else forward
            into.append(RDF + "type" if self.peek() == ("word", "a") and self.take() else self.term().value)
            if not many or not self.took("|"):
                break
        if many:
            self.take(")")
        return ("not", forward, backward)

    # -- expressions: ("var", n) ("term", t) ("call", name, args) ("op", symbol, a, b) ("not", e) ("minus", e) ("in", e, [e], negated) ("exists", g, negated) ("agg", name, distinct, e, separator)
    def expression(self):
        out = self.conjunction()
        while self.took("||"):
            out = ("op", "||", out, self.conjunction())
        return out

    def conjunction(self):
        out = self.relation()
        while self.took("&&"):
            out = ("op", "&&", out, self.relation())
        return out

    def relation(self):
        out = self.sum()
        if self.is_("=", "!=", "<", ">", "<=", ">="):
            return ("op", self.take()[1], out, self.sum())
        negated = self.is_("NOT")
        if negated or self.is_("IN"):
            if negated:
                self.take()
            self.take("IN")
            return ("in", out, self.arguments(), negated)
        return out

    def sum(self):
        out = self.product()
        while self.is_("+", "-"):
            out = ("op", self.take()[1], out, self.product())
        return out

    def product(self):
        out = self.unary()
        while self.is_("*", "/"):
            out = ("op", self.take()[1], out, self.unary())
        return out

    def unary(self):
        if self.took("!"):
            return ("not", self.unary())
        if self.is_("-", "+"):
            return ("minus", self.unary()) if self.take()[1] == "-" else self.unary()
        return self.primary()

    def arguments(self) -> list:
        self.take("(")
        out = []
        while not self.took(")"):
            out.append(self.expression())
            self.took(",")
        return out

    def primary(self):
        kind, text = self.peek()
        if self.took("("):
            e = self.expression()
            self.take(")")
            return e
        if kind == "var":
            return ("var", self.take()[1][1:])
        if kind == "word" and text.lower() not in ("true", "false"):
            name = self.take()[1].upper()
            if name == "NOT":
                self.take("EXISTS")
                return ("exists", self.group(), True)
            if name == "EXISTS":
                return ("exists", self.group(), False)
            if name in AGGREGATES:
                self.take("(")
                distinct = self.took("DISTINCT")
                e = None if self.took("*") else self.expression()
                separator = " "
                if self.took(";"):
                    self.take("SEPARATOR")
                    self.take("=")
                    separator = self.term().value
                self.take(")")
                return ("agg", name, distinct, e, separator)
            return ("call", name, self.arguments())
        if kind in ("iri", "name") and self.peek(1)[1] == "(":
            return ("call", self.iri(self.take()[1]), self.arguments())
        return ("term", self.term())


def parse(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, prefixes).parse()
