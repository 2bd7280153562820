"""SPARQL over a triple table, compiled to DataFrame plans.

A solution has one column per variable: a struct (v, kind, dt, lang), null where the
variable is unbound.  Struct equality takes null parts as equal, so a join on variables
is a plain hash-joinable equality.  Where OPTIONAL, UNION or VALUES may leave a variable
unbound, the rows are split into those that have it and those that lack it, so that each
part is again joined by equality.  Errors of expressions are nulls.
"""

from __future__ import annotations

import itertools
import tempfile
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import XSD
from .parser import Group, Query, Term, Var, parse

_NUMERIC = [XSD + x for x in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")] + ["https://schema.org/Number"]
_DOUBLES = [XSD + x for x in ("double", "float")]
_INTEGERS = [XSD + x for x in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")]
#: Sides that may both be unbound in more shared variables than this are compared row by row.
_SPLIT = 3
_TERM = "struct<v: string, kind: string, dt: string, lang: string>"


def _struct(v: Column, kind: Column | str, dt: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    made = F.struct(v.cast("string").alias("v"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (none if dt is None else dt).cast("string").alias("dt"), (none if lang is None else lang).cast("string").alias("lang"))
    return F.when(v.isNotNull(), made)


def _constant(t: Term) -> Column:
    return _struct(F.lit(t.value), t.kind, F.lit(t.datatype), F.lit(t.lang))


_WHOLE, _EXACT = "decimal(38,0)", "decimal(38,18)"


def _once(value: Column, body) -> Column:
    """``body`` of ``value``, which the plan holds once however often ``body`` names it: chained
    expressions would else double with every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fitted(value: Column, kind: str) -> Column:
    """A decimal as another kind, null where that is too short.  Its room is asked for first: a ``try_cast`` that
    fails makes an exception, which costs more than all else about a row."""
    digits, scale = map(int, kind[len("decimal(") : -1].split(","))
    return F.when(F.abs(value) < F.lit(Decimal(10) ** (digits - scale)), value.try_cast(kind))


class Number:
    """A number by XSD's order of types: whole, else decimal, else double; what a value is not, is null.

    Whole numbers have 38 digits, decimals 20 before the point and 18 after it.  What leaves
    these goes on as a double.  All three stand in one struct column.
    """

    def __init__(self, parts: Column):
        self.parts = parts

    double = property(lambda self: self.parts["d"])
    exact = property(lambda self: self.parts["e"])
    whole = property(lambda self: self.parts["w"])

    @staticmethod
    def made(double: Column, exact: Column | None = None, whole: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(double.cast("double").alias("d"), (none if exact is None else exact).try_cast(_EXACT).alias("e"), (none if whole is None else whole).try_cast(_WHOLE).alias("w"))

    @classmethod
    def of(cls, term: Column) -> Number:
        """Of a struct with ``v`` and ``dt``; whole and decimal types keep every digit."""

        def read(t: Column) -> Column:
            v, known = t["v"], t["dt"].isin(_NUMERIC)
            long_ = F.coalesce(F.abs(v.try_cast("double")) > 1e20, F.lit(False))  # no double of what fits is larger
            return cls.made(F.when(known, v.try_cast("double")), F.when(known & ~t["dt"].isin(_DOUBLES) & ~long_, v.try_cast(_EXACT)), F.when(t["dt"].isin(_INTEGERS), v.try_cast(_WHOLE)))

        return cls(_once(term, read))

    @classmethod
    def literal(cls, v: Column, datatype: str) -> Number:
        return cls.of(F.struct(v.alias("v"), F.lit(XSD + datatype).alias("dt")))

    @classmethod
    def counted(cls, n: Column) -> Number:
        return cls(_once(n, lambda n: cls.made(n, n, n)))

    def changed(self, body) -> Number:
        return Number(_once(self.parts, lambda x: body(Number(x))))

    def _with(self, other: Number, body) -> Column:
        return _once(F.struct(self.parts.alias("a"), other.parts.alias("b")), lambda x: body(Number(x["a"]), Number(x["b"])))

    def _of_both(self, other: Number, double, exact, whole) -> Number:
        return Number(self._with(other, lambda a, b: _once(whole(a.whole, b.whole), lambda w: self.made(double(a.double, b.double), F.coalesce(exact(a, b).try_cast(_EXACT), _fitted(w, _EXACT)), w))))

    def __add__(self, other: Number) -> Number:
        return self._of_both(other, lambda x, y: x + y, lambda a, b: F.try_add(a.exact, b.exact), F.try_add)

    def __sub__(self, other: Number) -> Number:
        return self._of_both(other, lambda x, y: x - y, lambda a, b: F.try_subtract(a.exact, b.exact), F.try_subtract)

    def __mul__(self, other: Number) -> Number:
        def exact(a: Number, b: Number) -> Column:
            x, y = _fitted(a.exact, "decimal(18,9)"), _fitted(b.exact, "decimal(18,9)")  # a product of these is whole in 37 digits
            fits = F.abs(a.exact.cast("double") * b.exact.cast("double")) < 1.001e20
            return F.coalesce(F.when((x == a.exact) & (y == b.exact), F.try_multiply(x, y)).try_cast(_EXACT), F.when(fits, F.try_multiply(a.exact, b.exact).try_cast(_EXACT)))

        return self._of_both(other, lambda x, y: x * y, exact, F.try_multiply)

    def __truediv__(self, other: Number) -> Number:
        """A quotient is a decimal where it ends within 18 places, else a double."""

        def divided(a: Number, b: Number) -> Column:
            x, y = _fitted(a.exact, "decimal(20,9)"), _fitted(b.exact, "decimal(20,9)")
            q = F.when((x == a.exact) & (y == b.exact), F.try_divide(x, y)).try_cast(_EXACT)
            short, by = _fitted(q, "decimal(24,12)"), _fitted(b.exact, "decimal(13,6)")
            ends = (short == q) & (F.try_multiply(short, by) == a.exact) & (by == b.exact)
            return self.made(F.try_divide(a.double, b.double), F.when(ends, q))

        return Number(self._with(other, divided))

    def __neg__(self) -> Number:
        return self.changed(lambda x: self.made(-x.double, -x.exact, -x.whole))

    def __abs__(self) -> Number:
        return self.changed(lambda x: self.made(F.abs(x.double), F.abs(x.exact), F.abs(x.whole)))

    def rounded(self, how) -> Number:
        """``how`` is F.floor or F.ceil."""
        return self.changed(lambda x: self.made(how(x.double), F.coalesce(how(x.exact).try_cast(_EXACT), x.whole.try_cast(_EXACT)), F.coalesce(x.whole, how(x.exact).try_cast(_WHOLE))))

    def cut(self) -> Number:
        """Towards zero, as whole."""

        def body(x: Number) -> Column:
            exact = F.coalesce(x.exact, x.double.try_cast(_EXACT))
            whole = F.coalesce(x.whole, F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact)).try_cast(_WHOLE))
            return self.made(whole, whole, whole)

        return self.changed(body)

    def compared(self, op, other: Number) -> Column:
        """Both are named several times: they are to stand in columns or in a ``_once``."""
        return (
            F.when(self.whole.isNotNull() & other.whole.isNotNull(), op(self.whole, other.whole))
            .when(self.exact.isNotNull() & other.exact.isNotNull(), op(self.exact, other.exact))
            .when(self.double.isNotNull() & other.double.isNotNull(), op(self.double, other.double))
        )

    @property
    def keys(self) -> list[Column]:
        """By which numbers are sorted: the double, then what it cannot tell apart."""
        return [self.double, self.whole, self.exact]

    @property
    def term(self) -> Column:
        def body(x: Column) -> Column:
            n = Number(x)
            point = F.regexp_replace(F.regexp_replace(n.exact.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
            v = F.coalesce(n.whole.cast("string"), F.when(n.exact == 0, F.lit("0")).otherwise(point), n.double.cast("string"))
            kind = F.when(n.whole.isNotNull(), "integer").when(n.exact.isNotNull(), "decimal").otherwise("double")
            return _struct(v, "literal", F.concat(F.lit(XSD), kind))

        return _once(self.parts, body)


class Value:
    """An expression in the forms that operators ask for."""

    def __init__(self, term: Column | None = None, *, number: Number | None = None, text: Column | None = None, truth: Column | None = None):
        self._term, self._number, self._text, self._truth = term, number, text, truth

    @property
    def numeric(self) -> bool:
        """A number whose term is made from it."""
        return self._term is None and self._number is not None

    @property
    def term(self) -> Column:
        if self._term is not None:
            return self._term
        if self._number is not None:
            return self._number.term
        if self._truth is not None:
            return _struct(self._truth.cast("string"), "literal", F.lit(XSD + "boolean"))
        return _struct(self._text, "literal")

    @property
    def number(self) -> Number:
        if self._number is not None:
            return self._number
        if self._term is None:
            return Number(Number.made(F.lit(None)))
        return Number.of(self._term)

    @property
    def text(self) -> Column:
        """The lexical form."""
        return self._text if self._text is not None else self.term["v"]

    @property
    def truth(self) -> Column:
        """The effective truth value, null for an error."""
        if self._truth is not None:
            return self._truth
        if self._number is not None:
            return self._number.double != 0
        if self._text is not None:
            return self._text != ""
        t = self._term
        plain = (t["kind"] == "literal") & t["dt"].isNull()
        return F.when(t["dt"] == XSD + "boolean", t["v"].isin("true", "1")).when(t["dt"].isin(_NUMERIC), F.coalesce(self.number.double != 0, F.lit(False))).when(plain, t["v"] != "")


class Solutions:
    """Rows of bindings: the frame, its variables in order, and those that may be unbound."""

    def __init__(self, frame: DataFrame, names: list[str], open_: set[str] | frozenset[str] = frozenset()):
        self.frame, self.names, self.open = frame, names, set(open_)


class Compiler:
    def __init__(self, triples: DataFrame, graph: DataFrame | None = None):
        self.triples = triples if "g" in triples.columns else triples.withColumn("g", F.lit(None).cast("string"))
        self.spark: SparkSession = triples.sparkSession
        self.scope: Column | None = None
        self.graph_var: str | None = None

    # -- patterns
    def source(self) -> DataFrame:
        return self.triples.where(self.scope) if self.scope is not None else self.triples

    def unit(self) -> Solutions:
        return Solutions(self.spark.range(1).select(F.lit(1).alias("_unit")), [])

    def pattern(self, s, p, o) -> Solutions:
        if isinstance(p, Var):
            edges = self.source().select(self._subject(), _struct(F.col("p"), "iri").alias("_p"), self._object(), "g")
        elif p[0] == "iri":
            edges = self._filtered(self.source().where(F.col("p") == p[1]), s, o).select(self._subject(), self._object(), "g")
        else:
            edges = self.path(p, s, o)
        names: list[str] = []
        places = [(s, "_s"), *([(p, "_p")] if isinstance(p, Var) else []), (o, "_o")]
        if self.graph_var:
            edges = edges.where(F.col("g").isNotNull()).withColumn("_g", _struct(F.col("g"), "iri"))
            places.append((Var(self.graph_var), "_g"))
        chosen: dict[str, Column] = {}
        for node, column in places:
            if isinstance(node, Term):
                edges = edges.where(F.col(column) == _constant(node))
            elif node.name in chosen:
                edges = edges.where(F.col(column) == chosen[node.name])
            else:
                chosen[node.name] = F.col(column)
                names.append(node.name)
        frame = edges.select(*[c.alias(n) for n, c in chosen.items()]) if chosen else edges.select(F.lit(1).alias("_unit"))
        return Solutions(frame, names)

    def _filtered(self, rows: DataFrame, s, o) -> DataFrame:
        """Constants as filters on flat columns, which reach the scan."""
        if isinstance(s, Term):
            rows = rows.where((F.col("s") == s.value) & (F.col("s_kind") == s.kind))
        if isinstance(o, Term):
            rows = rows.where((F.col("o") == o.value) & (F.col("o_kind") == o.kind))
        return rows

    def _subject(self) -> Column:
        return _struct(F.col("s"), F.col("s_kind")).alias("_s")

    def _object(self) -> Column:
        datatype = F.nullif(F.col("o_datatype"), F.lit(XSD + "string"))
        return _struct(F.col("o"), F.col("o_kind"), datatype, F.lower("o_lang")).alias("_o")

    def bgp(self, patterns: list) -> Solutions:
        """Constants first, then whatever shares a variable with what is there."""
        rest = list(patterns)
        cost = lambda t: (sum(isinstance(x, Var) for x in (t[0], t[2])) + 2 * isinstance(t[1], Var) + (not isinstance(t[1], Var) and t[1][0] not in ("iri",)))
        out = None
        bound: set[str] = set()
        while rest:
            near = [t for t in rest if bound & {x.name for x in t if isinstance(x, Var)}] or rest
            best = min(near, key=cost)
            rest.remove(best)
            found = self.pattern(*best)
            out = found if out is None else self.join(out, found)
            bound = set(out.names)
        return out or self.unit()

    def _edges(self, rows: DataFrame, start: Column, end: Column) -> DataFrame:
        """(_s, _o, g): under a graph variable an edge is of its graph, else of none."""
        return rows.select(start.alias("_s"), end.alias("_o"), (F.col("g") if self.graph_var else F.lit(None).cast("string")).alias("g"))

    def path(self, p, s=None, o=None) -> DataFrame:
        """(_s, _o, g) of a property path; all its edges are of one graph."""
        kind = p[0]
        subject, object_ = self._subject(), self._object()
        if kind == "iri":
            return self._edges(self.source().where(F.col("p") == p[1]), subject, object_).distinct()
        if kind == "inverse":
            return self.path(p[1]).select(F.col("_o").alias("_s"), F.col("_s").alias("_o"), "g")
        if kind == "alt":
            return self.path(p[1]).unionByName(self.path(p[2])).distinct() if p[1][0] != "alt" else self.path(p[1]).unionByName(self.path(p[2]))
        if kind == "seq":
            return self._chained(self.path(p[1]), self.path(p[2]))
        if kind == "not":
            parts = []
            if p[1] or not p[2]:
                parts.append(self._edges(self.source().where(~F.col("p").isin(p[1])), subject, object_))
            if p[2]:
                parts.append(self._edges(self.source().where(~F.col("p").isin(p[2])), object_, subject))
            return reduce(DataFrame.unionByName, parts)
        step = self.path(p[1]).distinct()
        if kind == "maybe":
            return step.unionByName(self._same(s, o)).distinct()
        closed = self._closure(step, s, o)
        return closed if kind == "plus" else closed.unionByName(self._same(s, o)).distinct()

    @staticmethod
    def _chained(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("_s").alias("_m"), F.col("_o").alias("_e"), F.col("g").alias("_h"))
        return a.join(b, (a["_o"] == b["_m"]) & a["g"].eqNullSafe(b["_h"])).select("_s", F.col("_e").alias("_o"), "g")

    def _same(self, s, o) -> DataFrame:
        """Every node with itself, and the constants of the pattern, which need not be in the graph."""
        rows = self.source()
        nodes = self._edges(rows, self._subject(), self._subject()).union(self._edges(rows, self._object(), self._object()))
        for t in (s, o):
            if isinstance(t, Term):
                graphs = rows.where("g IS NOT NULL").select("g").distinct() if self.graph_var else self.spark.range(1).select(F.lit(None).cast("string").alias("g"))
                nodes = nodes.union(self._edges(graphs, _constant(t), _constant(t)))
        return nodes.distinct()

    def _closure(self, step: DataFrame, s=None, o=None) -> DataFrame:
        """Pairs joined by one step or more; each round extends only pairs that were new, and writes only those.

        From a constant end the search goes outwards from it alone, so only what it reaches is ever touched.
        """
        context = self.spark.sparkContext
        if context.getCheckpointDir() is None:
            shared = context.getConf().get("spark.checkpoint.dir")
            if not shared and not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="paths_"))
        step = step.checkpoint()
        backwards = isinstance(o, Term) and not isinstance(s, Term)
        first = step.where(F.col("_s") == _constant(s)) if isinstance(s, Term) else step.where(F.col("_o") == _constant(o)) if backwards else step
        seen = new = first
        while True:
            longer = (self._chained(step, new) if backwards else self._chained(new, step)).distinct()
            met = seen.select(*[F.col(c).alias(f"_m{c}") for c in ("_s", "_o", "g")])
            known = (F.col("_s") == F.col("_m_s")) & (F.col("_o") == F.col("_m_o")) & F.col("g").eqNullSafe(F.col("_mg"))
            new = longer.join(met, known, "left_anti").checkpoint()
            if not new.limit(1).count():
                return seen
            seen = seen.unionByName(new)  # rounds that are checkpointed already

    # -- joins
    def _meeting(self, a: Solutions, right: DataFrame, b: Solutions, shared: list[str]) -> list[tuple[Column, list[tuple[DataFrame, list[str]]]]]:
        """Of each part of ``a`` the test for it, and the parts of ``right`` that it may meet with the variables that must be equal.

        A part is told by which of the shared variables are bound.
        """
        both = [n for n in shared if n in a.open or n in b.open]
        fixed = [n for n in shared if n not in both]
        out = []
        for here in itertools.product(*[(True, False) if n in a.open else (True,) for n in both]):
            mine = reduce(lambda x, y: x & y, [F.col(n).isNotNull() if bound else F.col(n).isNull() for n, bound in zip(both, here, strict=True)], F.lit(True))
            parts = []
            for there in itertools.product(*[(True, False) if n in b.open else (True,) for n in both]):
                test = reduce(lambda x, y: x & y, [F.col(f"_r_{n}").isNotNull() if bound else F.col(f"_r_{n}").isNull() for n, bound in zip(both, there, strict=True)], F.lit(True))
                parts.append((right.where(test), fixed + [n for n, x, y in zip(both, here, there, strict=True) if x and y]))
            out.append((mine, parts))
        return out

    @staticmethod
    def _equal(names: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(n) == F.col(f"_r_{n}") for n in names], F.lit(True))

    def join(self, a: Solutions, b: Solutions, how: str = "inner", test=None) -> Solutions:
        shared = [n for n in a.names if n in b.names]
        right = b.frame.select(*[F.col(n).alias(f"_r_{n}") for n in b.names], *([F.lit(1).alias("_r_unit")] if not b.names else []))
        merged = [F.coalesce(F.col(n), F.col(f"_r_{n}")).alias(n) if n in shared and n in a.open else F.col(n) for n in a.names]
        added = [n for n in b.names if n not in a.names]
        extra = F.lit(True)
        if test is not None:  # the filters of an OPTIONAL see both sides
            view = {n: F.coalesce(F.col(n), F.col(f"_r_{n}")) if n in shared else F.col(n) for n in a.names} | {n: F.col(f"_r_{n}") for n in added}
            extra = F.coalesce(test(view), F.lit(False))
        shown = [*merged, *[F.col(f"_r_{n}").alias(n) for n in added], *([] if a.names or added else [F.lit(1).alias("_unit")])]
        opened = (a.open & b.open) | {n for n in a.open if n not in b.names} | {n for n in b.open if n not in a.names}
        if how == "left":
            opened = a.open | b.open.difference(a.names) | set(added)
        may = [n for n in shared if n in a.open or n in b.open]
        if not may or len(may) > _SPLIT:
            wide = [F.lit(True) if n not in may else F.col(n).isNull() | F.col(f"_r_{n}").isNull() for n in shared]
            terms = [F.col(n) == F.col(f"_r_{n}") if n not in may else (F.col(n) == F.col(f"_r_{n}")) | w for n, w in zip(shared, wide, strict=True)]
            frame = a.frame.join(right, reduce(lambda x, y: x & y, terms, extra), how).select(*shown)
            return Solutions(frame, a.names + added, opened)
        frames = []
        for mine, parts in self._meeting(a, right, b, shared):
            rows = rest = a.frame.where(mine)
            for part, equal in parts:
                frames.append(rows.join(part, self._equal(equal) & extra).select(*shown))
                rest = rest.join(part, self._equal(equal) & extra, "left_anti")
            if how == "left":  # what met nothing in any part
                frames.append(rest.select(*[F.col(n) for n in a.names], *[F.lit(None).cast(_TERM).alias(n) for n in added], *([] if a.names or added else [F.lit(1).alias("_unit")])))
        return Solutions(reduce(DataFrame.unionByName, frames), a.names + added, opened)

    def without(self, a: Solutions, b: Solutions, how: str = "left_anti", minus: bool = False, test=None) -> Solutions:
        """Rows of ``a`` with (left_semi) or without (left_anti) a compatible row of ``b``."""
        shared = [n for n in a.names if n in b.names]
        if minus and not shared:
            return a
        right = b.frame.select(*[F.col(n).alias(f"_r_{n}") for n in b.names], *([F.lit(1).alias("_r_unit")] if not b.names else []))
        extra = F.lit(True)
        if test is not None:
            extra = F.coalesce(test({n: F.col(f"_r_{n}") for n in b.names} | {n: F.col(n) for n in a.names}), F.lit(False))
        may = [n for n in shared if n in a.open or n in b.open]
        if len(may) <= _SPLIT:
            frames = []
            for mine, parts in self._meeting(a, right, b, shared):
                rest = a.frame.where(mine)
                for part, equal in parts:
                    if minus and not equal:  # solutions without a common binding take nothing away
                        continue
                    if how == "left_semi":
                        frames.append(rest.join(part, self._equal(equal) & extra, "left_semi"))
                    rest = rest.join(part, self._equal(equal) & extra, "left_anti")
                if how == "left_anti":
                    frames.append(rest)
            return Solutions(reduce(DataFrame.unionByName, frames), a.names, a.open)
        condition, meets = extra, F.lit(False)
        for n in shared:
            same = F.col(n) == F.col(f"_r_{n}")
            if n in may:
                meets = meets | (F.col(n).isNotNull() & F.col(f"_r_{n}").isNotNull())
                same = same | F.col(n).isNull() | F.col(f"_r_{n}").isNull()
            else:
                meets = F.lit(True)
            condition = condition & same
        return Solutions(a.frame.join(right, condition & meets if minus else condition, how), a.names, a.open)

    def group(self, g: Group) -> Solutions:
        out = None
        filters = [p[1] for p in g.parts if p[0] == "filter"]
        for part in g.parts:
            kind = part[0]
            if kind == "filter":
                continue
            here = out or self.unit()
            if kind == "optional":
                inner, tests = Group([p for p in part[1].parts if p[0] != "filter" or _exists(p[1])]), [p[1] for p in part[1].parts if p[0] == "filter" and not _exists(p[1])]
                test = (lambda view, tests=tests: reduce(lambda x, y: x & y, [self.value(e, view).truth for e in tests])) if tests else None
                out = self.join(here, self.group(inner), "left", test)
            elif kind == "minus":
                out = self.without(here, self.group(part[1]), minus=True)
            elif kind == "bind":
                if part[2] in here.names:
                    raise ValueError(f"?{part[2]} is bound already")
                # out of a generator, so that the optimizer does not write the value wherever the variable is named
                bound = F.explode(F.array(self.value(part[1], _view(here)).term)).alias(part[2])
                out = Solutions(here.frame.select("*", bound), here.names + [part[2]], here.open | {part[2]})
            else:
                found = self.part(part)
                out = found if out is None else self.join(out, found)
        out = out or self.unit()
        for e in filters:
            out = self.filter(out, e)
        return out

    def part(self, part) -> Solutions:
        kind = part[0]
        if kind == "bgp":
            return self.bgp(part[1])
        if kind == "group":
            return self.group(part[1])
        if kind == "select":
            return self.select(part[1])
        if kind == "values":
            return self.values(part[1], part[2])
        if kind == "graph":
            before = self.scope, self.graph_var
            if isinstance(part[1], Term):
                self.scope, self.graph_var = F.col("g") == part[1].value, None
            else:
                self.scope, self.graph_var = None, part[1].name
            out = self.group(part[2])
            self.scope, self.graph_var = before
            return out
        options = [self.group(g) for g in part[1]]
        names = list(dict.fromkeys(n for s in options for n in s.names))
        frames = [s.frame.select(*[F.col(n) if n in s.names else F.lit(None).cast(_TERM).alias(n) for n in names], F.lit(1).alias("_unit")) for s in options]
        opened = {n for n in names if any(n not in s.names or n in s.open for s in options)}
        return Solutions(reduce(DataFrame.unionByName, frames).select(*(names or ["_unit"])), names, opened)

    def values(self, names: list[str], rows: list) -> Solutions:
        data = [tuple(None if t is None else (t.value, t.kind, t.datatype, t.lang) for t in row) for row in rows]
        schema = ", ".join(f"`{n}` {_TERM}" for n in names)
        return Solutions(self.spark.createDataFrame(data, schema), names, {n for k, n in enumerate(names) if any(r[k] is None for r in rows)})

    def filter(self, rows: Solutions, e) -> Solutions:
        if e[0] == "op" and e[1] == "&&":
            return self.filter(self.filter(rows, e[2]), e[3])
        if e[0] == "not" and e[1][0] == "exists":
            e = ("exists", e[1][1], not e[1][2])
        if e[0] == "exists":
            inner = Group([p for p in e[1].parts if p[0] != "filter" or _exists(p[1])])
            tests = [p[1] for p in e[1].parts if p[0] == "filter" and not _exists(p[1])]
            test = (lambda view: reduce(lambda x, y: x & y, [self.value(t, view).truth for t in tests])) if tests else None
            return self.without(rows, self.group(inner), "left_anti" if e[2] else "left_semi", test=test)
        marked, e = self._marked(rows, e) if _exists(e) else (rows, e)
        frame = marked.frame.where(self.value(e, _view(marked)).truth)
        return Solutions(frame.select(*(rows.names or ["_unit"])), rows.names, rows.open)

    def _marked(self, rows: Solutions, e) -> tuple[Solutions, tuple]:
        """Adds a truth column for each EXISTS inside an expression, and puts it in its place."""
        if e[0] == "exists":
            name = f"_exists{len(rows.names)}"
            kept = list(rows.names)
            there = self.filter(Solutions(rows.frame.select(*kept).distinct() if kept else rows.frame, kept, rows.open), ("exists", e[1], False))
            flag = there.frame.select(*[F.col(n).alias(f"_r_{n}") for n in kept], F.lit(True).alias("_there"))
            same = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in kept], F.lit(True))
            frame = rows.frame.join(flag, same, "left").withColumn(name, _struct(F.coalesce(F.col("_there"), F.lit(False)).cast("string"), "literal", F.lit(XSD + "boolean")))
            frame = frame.select(*kept, name, *(["_unit"] if "_unit" in rows.frame.columns else []))
            found = ("var", name)
            return Solutions(frame, [*kept, name], rows.open), ("not", found) if e[2] else found
        parts = []
        for x in e:
            if isinstance(x, tuple) and _exists(x):
                rows, x = self._marked(rows, x)
            elif isinstance(x, list):
                given, x = x, []
                for y in given:
                    if isinstance(y, tuple) and _exists(y):
                        rows, y = self._marked(rows, y)
                    x.append(y)
            parts.append(x)
        return rows, tuple(parts)

    # -- expressions
    def value(self, e, view: dict[str, Column], aggregates: dict | None = None) -> Value:
        again = lambda x: self.value(x, view, aggregates)
        kind = e[0]
        if kind == "var":
            return Value(view.get(e[1], F.lit(None).cast(_TERM)))
        if kind == "term":
            t = e[1]
            return Value(_constant(t), number=Number.of(_constant(t))) if t.datatype in _NUMERIC else Value(_constant(t))
        if kind == "agg":
            return Value(aggregates[repr(e)])
        if kind == "not":
            return Value(truth=~again(e[1]).truth)
        if kind == "minus":
            return Value(number=-again(e[1]).number)
        if kind == "in":
            found = reduce(lambda x, y: x | y, [_compare("=", again(e[1]), again(x)) for x in e[2]], F.lit(False))
            return Value(truth=~found if e[3] else found)
        if kind == "exists":
            raise ValueError("EXISTS stands in a FILTER only")
        if kind == "op":
            a, b = again(e[2]), again(e[3])
            if e[1] == "&&":
                return Value(truth=a.truth & b.truth)
            if e[1] == "||":
                return Value(truth=a.truth | b.truth)
            if e[1] in "+-*/":
                x, y = a.number, b.number
                return Value(number={"+": x.__add__, "-": x.__sub__, "*": x.__mul__, "/": x.__truediv__}[e[1]](y))
            return Value(truth=_compare(e[1], a, b))
        return self.call(e[1], e[2], again)

    def call(self, name: str, args: list, again) -> Value:
        v = [again(a) for a in args]
        t = v[0].term if v else None
        if name == "BOUND":
            return Value(truth=t.isNotNull())
        if name == "IF":
            return Value(F.when(v[0].truth, v[1].term).when(~v[0].truth, v[2].term))
        if name == "COALESCE":
            return Value(F.coalesce(*[x.term for x in v]))
        if name == "STR":
            return Value(text=v[0].text)
        if name == "LANG":
            return Value(text=F.when(t["kind"] == "literal", F.coalesce(t["lang"], F.lit(""))))
        if name == "LANGMATCHES":
            tag, wanted = F.lower(v[0].text), F.lower(v[1].text)
            return Value(truth=F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))))
        if name == "DATATYPE":
            kind = F.when(t["lang"].isNotNull(), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).otherwise(F.coalesce(t["dt"], F.lit(XSD + "string")))
            return Value(_struct(F.when(t["kind"] == "literal", kind), "iri"))
        if name in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK"):
            return Value(truth=t["kind"] == {"ISIRI": "iri", "ISURI": "iri", "ISLITERAL": "literal", "ISBLANK": "bnode"}[name])
        if name == "ISNUMERIC":
            return Value(truth=F.when(t.isNotNull(), v[0].number.double.isNotNull()))
        if name == "SAMETERM":
            return Value(truth=t == v[1].term)
        if name in ("IRI", "URI"):
            return Value(_struct(v[0].text, "iri"))
        if name == "STRDT":
            return Value(_struct(v[0].text, "literal", F.nullif(v[1].text, F.lit(XSD + "string"))))
        if name == "STRLANG":
            return Value(_struct(v[0].text, "literal", None, F.lower(v[1].text)))
        text = [x.text for x in v]
        like = lambda c: Value(_struct(c, "literal", t["dt"], t["lang"]))  # noqa: E731  keeps language and type
        if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
            return Value(truth={"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name](text[0], text[1]))
        if name == "REGEX":
            flags = F.concat(F.lit("(?u"), text[2], F.lit(")")) if len(text) > 2 else F.lit("(?u)")
            return Value(truth=F.regexp_like(text[0], F.concat(flags, text[1])))
        if name == "REPLACE":
            pattern = F.concat(F.lit("(?u"), text[3], F.lit(")"), text[1]) if len(text) > 3 else text[1]
            return like(F.regexp_replace(text[0], pattern, text[2]))
        if name == "SUBSTR":
            # places from 1; those before it count for the length
            first = F.round(v[1].number.double).cast("int")
            end = first + F.round(v[2].number.double).cast("int") if len(v) > 2 else F.lit((1 << 31) - 1)
            start = F.greatest(first, F.lit(1))
            return like(F.substring(text[0], start, F.greatest(end - start, F.lit(0))))
        if name in ("UCASE", "LCASE"):
            return like((F.upper if name == "UCASE" else F.lower)(text[0]))
        if name == "STRBEFORE":
            before = like(F.substring(text[0], F.lit(1), F.position(text[1], text[0]) - 1)).term
            return Value(F.when(F.contains(text[0], text[1]), before).when(~F.contains(text[0], text[1]), _struct(F.lit(""), "literal")))
        if name == "STRAFTER":
            after = like(F.substring(text[0], F.position(text[1], text[0]) + F.length(text[1]), F.lit(1 << 30))).term
            return Value(F.when(F.contains(text[0], text[1]), after).when(~F.contains(text[0], text[1]), _struct(F.lit(""), "literal")))
        if name == "STRLEN":
            return Value(number=Number.counted(F.length(text[0])))
        if name == "CONCAT":
            if not text:
                return Value(text=F.lit(""))
            same = reduce(lambda x, y: x & y, [t["lang"].eqNullSafe(x.term["lang"]) for x in v])
            return Value(_struct(F.concat(*text), "literal", None, F.when(same, t["lang"])))
        if name == "ENCODE_FOR_URI":
            return Value(text=F.replace(F.url_encode(text[0]), F.lit("+"), F.lit("%20")))
        if name in ("MD5", "SHA1"):
            return Value(text=(F.md5 if name == "MD5" else F.sha1)(text[0].cast("binary")))
        if name in ("SHA256", "SHA384", "SHA512"):
            return Value(text=F.sha2(text[0].cast("binary"), int(name[3:])))
        if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
            n = v[0].number
            if name == "ROUND":  # halves go up
                return Value(number=(n + Number.literal(F.lit("0.5"), "decimal")).rounded(F.floor))
            return Value(number=abs(n) if name == "ABS" else n.rounded(F.ceil if name == "CEIL" else F.floor))
        if name in ("YEAR", "MONTH", "DAY"):
            part = {"YEAR": r"^(-?\d{4,})-", "MONTH": r"^-?\d{4,}-(\d\d)", "DAY": r"^-?\d{4,}-\d\d-(\d\d)"}[name]
            return Value(number=Number.counted(F.nullif(F.regexp_extract(text[0], part, 1), F.lit("")).try_cast(_WHOLE)))
        if name in ("HOURS", "MINUTES", "SECONDS"):
            part = {"HOURS": r"T(\d\d):", "MINUTES": r"T\d\d:(\d\d)", "SECONDS": r"T\d\d:\d\d:(\d\d(?:\.\d+)?)"}[name]
            found = F.nullif(F.regexp_extract(text[0], part, 1), F.lit(""))
            return Value(number=Number.literal(found, "decimal" if name == "SECONDS" else "integer"))
        if name == "TZ":
            return Value(text=F.regexp_extract(text[0], r"T[0-9:.]+(Z|[+-]\d\d:\d\d)$", 1))
        if name == "TIMEZONE":
            zone = F.nullif(F.regexp_extract(text[0], r"T[0-9:.]+(Z|[+-]\d\d:\d\d)$", 1), F.lit(""))
            hours, minutes = F.regexp_extract(zone, r"(\d\d):", 1).try_cast("int"), F.regexp_extract(zone, r":(\d\d)", 1).try_cast("int")
            length = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
            found = F.when(zone.isNull(), F.lit(None)).when((zone == "Z") | (length == ""), F.lit("PT0S")).otherwise(F.concat(F.when(zone.startswith("-"), F.lit("-PT")).otherwise("PT"), length))
            return Value(_struct(found, "literal", F.lit(XSD + "dayTimeDuration")))
        if name == "NOW":
            return Value(_struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "literal", F.lit(XSD + "dateTime")))
        if name == "RAND":
            return Value(_struct(F.rand().cast("string"), "literal", F.lit(XSD + "double")))
        if name in ("UUID", "STRUUID"):
            return Value(_struct(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri")) if name == "UUID" else Value(_struct(F.uuid(), "literal"))
        if name == "BNODE":  # the same label gives the same node
            return Value(_struct(F.concat(F.lit("_:b"), F.md5(text[0].cast("binary")) if text else F.replace(F.uuid(), F.lit("-"))), "bnode"))
        if name in (XSD + "integer", XSD + "double", XSD + "decimal", XSD + "float"):
            if name.endswith("integer"):  # a text may be written as any number
                return Value(number=Number(_once(text[0], lambda x: Number.made(x.try_cast("double"), x, F.when(F.regexp_like(x, F.lit(r"^[+-]?\d+$")), x)))).cut())
            if name.endswith("decimal"):
                return Value(number=Number(_once(text[0], lambda x: Number.made(x.try_cast("double"), F.coalesce(x.try_cast(_EXACT), x.try_cast("double").try_cast(_EXACT))))))
            return Value(_struct(text[0].try_cast("double").cast("string"), "literal", F.lit(name)))
        if name == XSD + "string":
            return Value(text=text[0])
        if name == XSD + "boolean":
            return Value(truth=v[0].truth)
        raise ValueError(f"unknown function {name}")

    # -- whole queries
    def select(self, q: Query) -> Solutions:
        rows = self.group(q.where)
        if q.values:
            rows = self.join(rows, self.values(*q.values))
        aggregated = q.group or any(_aggregates(e) for _, e in q.items if e) or any(_aggregates(e) for e in q.having)
        items = q.items or [(n, None) for n in rows.names if not n.startswith("_")]
        if aggregated:
            rows, calls = self.aggregate(rows, q, items)
        else:
            calls = None
        frame, names = rows.frame, list(rows.names)
        for name, e in items:
            if e is not None and name not in names:
                frame = frame.withColumn(name, self.value(e, {n: F.col(n) for n in names}, calls).term)
                names.append(name)
        view = {n: F.col(n) for n in names}
        missing = [n for n, e in items if n not in view]
        frame = frame.withColumns({n: F.lit(None).cast(_TERM) for n in missing}) if missing else frame
        if q.order:
            keys = []
            for e, down in q.order:
                value = self.value(e, view, calls)
                turn = (lambda c: c.desc_nulls_last()) if down else (lambda c: c.asc_nulls_first())
                keys += [turn(value.term.isNotNull()), *map(turn, value.number.keys), turn(value.text)]
            frame = frame.orderBy(*keys)
        shown = [n for n, _ in items]
        frame = frame.select(*shown) if shown else frame.select("_unit") if "_unit" in frame.columns else frame
        if q.distinct:
            frame = self._distinct(frame, q, view, shown, calls)
        if q.offset:
            frame = frame.offset(q.offset)
        if q.limit is not None:
            frame = frame.limit(q.limit)
        return Solutions(frame, shown, {n for n in shown if n in rows.open or n not in rows.names})

    def _distinct(self, frame: DataFrame, q: Query, view, shown: list[str], calls) -> DataFrame:
        """Distinct first, and the order again after it where it only needs what is shown."""
        frame = frame.distinct()
        keys = []
        for e, down in q.order:
            if _variables(e) - set(shown):
                raise ValueError("ORDER BY of a DISTINCT query takes selected variables only")
            value = self.value(e, {n: F.col(n) for n in shown}, calls)
            turn = (lambda c: c.desc_nulls_last()) if down else (lambda c: c.asc_nulls_first())
            keys += [turn(value.term.isNotNull()), *map(turn, value.number.keys), turn(value.text)]
        return frame.orderBy(*keys) if keys else frame

    def aggregate(self, rows: Solutions, q: Query, items: list):
        view = _view(rows)
        keys = {}
        for k, (name, e) in enumerate(q.group):
            keys[name or (e[1] if e[0] == "var" else f"_k{k}")] = self.value(e, view).term
        calls: dict[str, object] = {}
        for e in [e for _, e in items if e] + q.having + [e for e, _ in q.order]:
            for a in _aggregates(e):
                calls.setdefault(repr(a), a)
        made = {}
        for k, (text, (_, name, distinct, e, separator)) in enumerate(calls.items()):
            v = self.value(e, view) if e is not None else None
            number = v.number if v else None
            if name == "COUNT":
                if e is None:
                    n = F.count_distinct(F.struct(*[F.coalesce(F.col(x), F.struct(*[F.lit(None).cast("string").alias(y) for y in ("v", "kind", "dt", "lang")])) for x in rows.names])) if distinct else F.count(F.lit(1))
                else:
                    n = F.count_distinct(v.term) if distinct else F.count(v.term)
                made[text] = _struct(n.cast("bigint"), "literal", F.lit(XSD + "integer"))
            elif name in ("SUM", "AVG"):
                add = F.sum_distinct if distinct else F.sum
                many = F.count_distinct(number.double) if distinct else F.count(number.double)
                # exact as long as every number is; what is added may be longer than a decimal holds
                all_whole, all_exact = F.count(number.whole) == F.count(number.double), F.count(number.exact) == F.count(number.double)
                zero = F.lit(0)
                total = Number(Number.made(F.coalesce(add(number.double), zero.cast("double")), F.when(all_exact, F.coalesce(add(number.exact), zero.cast(_EXACT))), F.when(all_whole, F.coalesce(add(number.whole), zero.cast(_WHOLE)))))
                if name == "AVG":
                    total = Number(F.when(many == 0, Number.made(zero, zero, zero)).otherwise((total / Number.counted(many)).parts))
                made[text] = total.term
            elif name in ("MIN", "MAX"):
                f = F.min_by if name == "MIN" else F.max_by
                # blank nodes, IRIs, numbers by value, other literals by their text
                rank = F.when(v.term["kind"] == "bnode", 0).when(v.term["kind"] == "iri", 1).when(number.double.isNotNull(), 2).otherwise(3)
                made[text] = f(v.term, F.when(v.term.isNotNull(), F.struct(rank, *[F.coalesce(x, F.lit(0).cast(kind)) for x, kind in zip(number.keys, ("double", _WHOLE, _EXACT), strict=True)], v.text)))
            elif name == "SAMPLE":
                made[text] = F.min(v.term)
            else:
                gathered = F.collect_set(v.text) if distinct else F.collect_list(v.text)
                made[text] = Value(text=F.array_join(F.sort_array(gathered), separator)).term
        named = {text: f"_a{k}" for k, text in enumerate(made)}
        frame = rows.frame.select(*[c.alias(n) for n, c in keys.items()], *[F.col(n).alias(f"_in_{n}") for n in rows.names], *(["_unit"] if "_unit" in rows.frame.columns else []))
        inner = {n: F.col(f"_in_{n}") for n in rows.names}
        frame = rows.frame.withColumns({f"_key_{n}": c for n, c in keys.items()})
        aggregates = [c.alias(named[text]) for text, c in made.items()]
        grouped = frame.groupBy(*[F.col(f"_key_{n}") for n in keys])
        frame = grouped.agg(*(aggregates or [F.count(F.lit(1)).alias("_n")]))
        frame = frame.select(*[F.col(f"_key_{n}").alias(n) for n in keys], *[F.col(c) for c in frame.columns if not c.startswith("_key_")])
        del inner
        columns = {text: F.col(n) for text, n in named.items()}
        for e in q.having:
            frame = frame.where(self.value(e, {n: F.col(n) for n in keys}, columns).truth)
        return Solutions(frame, list(keys), {n for n in keys if n in rows.open}), columns

    def run(self, q: Query) -> DataFrame:
        """SELECT: string columns. ASK: one boolean. CONSTRUCT and DESCRIBE: triples."""
        if q.graphs:
            self.scope = F.col("g").isin(q.graphs)
        if q.form == "SELECT":
            found = self.select(q)
            return found.frame.select(*[F.col(n)["v"].alias(n) for n in found.names])
        if q.form == "ASK":
            return self.group(q.where).frame.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        if q.form == "CONSTRUCT":
            return self.construct(q)
        return self.describe(q)

    def construct(self, q: Query) -> DataFrame:
        rows = self.select(Query("SELECT", q.where, [], order=q.order, limit=q.limit, offset=q.offset))
        view = {n: F.col(n) for n in rows.names}
        made = []
        for s, p, o in q.template:
            ends = []
            for node in (s, p if isinstance(p, Var) else Term(p[1], "iri"), o):
                if isinstance(node, Term):
                    ends.append(_constant(node))
                elif node.name in view:
                    ends.append(view[node.name])
                else:  # a blank node of its own per solution
                    ends.append(_struct(F.concat(F.lit(f"_:{node.name.strip('_')}_"), F.md5(F.to_json(F.struct(*[view[n].alias(n) for n in rows.names] or [F.lit(0).alias("z")])))), "bnode"))
            made.append(F.struct(ends[0].alias("a"), ends[1].alias("b"), ends[2].alias("c")))
        whole = rows.frame.select(F.inline(F.array(*made))).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND a.kind <> 'literal' AND b.kind = 'iri'")
        return whole.select(
            F.col("a.v").alias("s"), F.col("a.kind").alias("s_kind"), F.col("b.v").alias("p"), F.col("c.v").alias("o"), F.col("c.kind").alias("o_kind"), F.col("c.dt").alias("o_datatype"), F.col("c.lang").alias("o_lang")
        ).distinct()

    def describe(self, q: Query) -> DataFrame:
        """Triples that have the resource as subject or object."""
        fixed = [e[1] for _, e in q.items if e and e[0] == "term"]
        names = [e[1] for _, e in q.items if e and e[0] == "var"]
        wanted = self.spark.createDataFrame([(t.value,) for t in fixed], "r string")
        if names or any(n == "*" for n, _ in q.items):
            found = self.group(q.where)
            for n in names or found.names:
                wanted = wanted.union(found.frame.select(F.col(n)["v"].alias("r")))
        wanted = wanted.where("r IS NOT NULL").distinct()
        columns = ["s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang"]
        base = self.source().select(*columns)
        return base.join(wanted, base["s"] == wanted["r"], "left_semi").union(base.where("o_kind <> 'literal'").join(wanted, base["o"] == wanted["r"], "left_semi")).distinct()


def _view(rows: Solutions) -> dict[str, Column]:
    return {n: F.col(n) for n in rows.names}


def _exists(e) -> bool:
    if isinstance(e, list):
        return any(map(_exists, e))
    return isinstance(e, tuple) and bool(e) and (e[0] == "exists" or any(_exists(x) for x in e[1:] if isinstance(x, tuple | list)))


def _aggregates(e) -> list:
    if isinstance(e, tuple) and e and e[0] == "agg":
        return [e]
    return [a for x in e for a in _aggregates(x)] if isinstance(e, tuple | list) else []


def _variables(e) -> set[str]:
    if isinstance(e, tuple) and e and e[0] == "var":
        return {e[1]}
    return set().union(*(_variables(x) for x in e)) if isinstance(e, tuple | list) and e else set()


def _compare(op: str, a: Value, b: Value) -> Column:
    """Each side is computed once; the term of a number only where numbers do not decide."""
    signs = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}
    sides = [F.struct(v.number.parts.alias("n"), *([] if v.numeric else [v.term.alias("t")])) for v in (a, b)]

    def body(v: Column) -> Column:
        x, y = Number(v["a"]["n"]), Number(v["b"]["n"])
        s, t = x.term if a.numeric else v["a"]["t"], y.term if b.numeric else v["b"]["t"]
        both, numbers = x.double.isNotNull() & y.double.isNotNull(), x.compared(signs[op], y)
        if op in ("=", "!="):
            return F.when(both, numbers).otherwise(signs[op](s, t))
        comparable = (s["kind"] == "literal") & (t["kind"] == "literal") & s["dt"].eqNullSafe(t["dt"]) & x.double.isNull() & y.double.isNull()
        return F.when(both, numbers).when(comparable, signs[op](s["v"], t["v"]))

    return _once(F.struct(sides[0].alias("a"), sides[1].alias("b")), body)


def query(triples: DataFrame, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    return Compiler(triples).run(parse(text, prefixes))


def bindings(triples: DataFrame, text: str, prefixes: dict[str, str] | None = None) -> Solutions:
    """A SELECT with whole terms, for the endpoint."""
    compiler = Compiler(triples)
    q = parse(text, prefixes)
    if q.graphs:
        compiler.scope = F.col("g").isin(q.graphs)
    return compiler.select(q)
