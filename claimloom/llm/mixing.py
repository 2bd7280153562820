"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic).  The cells' weights are raked:
each sweep scales them so that the sources, then the languages, then the topics carry
their target shares, until no weight moves any more.  A document of a cell is kept with
probability min(1, c * weight / tokens), where c is set so that the expected tokens
meet the budget; a keyed hash of the id decides, so that a second run keeps the same.

A raked weight is tokens * a[source] * b[language] * t[topic], and a follows from b and t
alone.  So the cells stay a table, of any number; a sweep is one aggregation of them to
languages by topics, from which the driver scales b and t.  Languages and topics are the
small dimensions, held by the driver; their number is checked against ``most_pairs``.

Targets not given are the observed shares to the power ``damping``, which lifts small
groups.  Without a ``topic`` column the form of a text stands for its topic.

Defined cases: a null source, language or topic is a group of its own; a null or blank
text has no token and takes its cell's probability, or 1 where the cell has no token; texts
of any length are counted whole; rows that repeat an id are kept or not together within a
cell; a target group without documents gets nothing and the others keep their proportions;
targets that contradict each other are met as far as the last sweep goes, topics exactly;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, sized, write_table

NONE = "\0null"
DIMS = ("source", "lang", "topic")


def form_topic(text: Column) -> Column:
    """A topic by the form of a text: table, shout, short, notes or prose."""
    text = F.coalesce(text, F.lit(""))
    size, lines = F.length(text), F.size(F.split(text, "\n"))
    return (
        F.when(size < 200, "short").when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("!! ")), "shout").when(size < lines * 120, "notes").otherwise("prose")
    )


def n_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")).cast("long")


def _targets(shares: Mapping[str, float], wanted: Mapping[str, float] | None, damping: float) -> dict[str, float]:
    out = {k: max(0.0, wanted.get(k, 0.0)) if wanted is not None else float(v) ** damping for k, v in shares.items() if v > 0}
    total = sum(out.values())
    return {k: v / total for k, v in out.items()} if total else {k: 1 / len(out) for k in out}


def mix(
    docs: DataFrame,
    topic: Column | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    source_targets: Mapping[str, float] | None = None,
    lang_targets: Mapping[str, float] | None = None,
    topic_targets: Mapping[str, float] | None = None,
    damping: float = 0.7,
    keep: float = 0.8,
    seed: int = 1,
) -> DataFrame:
    """One row per input row: id, n_tokens, source, lang, topic, weight, probability, kept.

    ``weight`` is the cell's share of the mixture; ``keep`` the part of all tokens to keep.
    """
    topic = form_topic(F.col(text_col)) if topic is None else topic
    named = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for c, n in zip((F.col(source_col), F.col(lang_col), topic), DIMS, strict=True)]
    base = docs.select(F.col(id_col).alias("id"), n_tokens(F.col(text_col)).alias("n_tokens"), *named)
    cells, cells_path = write_table(base.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    weighted = rake(cells, dict(zip(DIMS, (source_targets, lang_targets, topic_targets), strict=True)), damping)
    rates, path = write_table(probabilities(weighted, keep), "rates")
    drop_table(docs.sparkSession, cells_path)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 40)) / float(1 << 40)
    out = base.join(sized(rates, path), list(DIMS), "left")
    shown = [F.nullif(F.col(n), F.lit(NONE)).alias(n) for n in DIMS]
    return out.select(F.col("id").alias(id_col), "n_tokens", *shown, "weight", "probability", (draw < F.col("probability")).alias("kept"))


def _column(factors: Mapping[str, float], of: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in factors.items() for x in pair]).cast("map<string, double>"), F.col(of))


def rake(cells: DataFrame, wanted: Mapping[str, Mapping[str, float] | None], damping: float = 0.7, *, sweeps: int = 2000, close: float = 1e-10, most_pairs: int = 250_000) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``: all weights sum to one.

    Ends when no group's share, as the next sweep would scale it, is off by more than
    ``close``, or after ``sweeps`` where targets contradict each other; a warning then tells the largest miss.
    """
    spark = cells.sparkSession
    profiles = cells.where("tokens > 0").groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "tokens")).alias("held"), F.sum("tokens").alias("tokens"))
    pairs = cells.where("tokens > 0").groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(most_pairs + 1).collect()
    if len(pairs) > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs of language and topic: they are the small dimensions")
    total = float(sum(r["tokens"] for r in pairs))
    if not total:
        return cells.withColumn("weight", F.lit(0.0))
    goals = {}
    for d in DIMS[1:]:
        sums: dict[str, float] = {}
        for r in sorted(pairs, key=lambda r: (r["lang"], r["topic"])):
            sums[r[d]] = sums.get(r[d], 0.0) + r["tokens"] / total
        goals[d] = _targets(sums, wanted[d], damping)
    profiles, path = write_table(_source_goals(profiles, wanted["source"], damping, total), "profiles")
    factors = {d: dict.fromkeys(goals[d], 1.0) for d in DIMS[1:]}
    for _ in range(sweeps):
        cell = F.transform("held", lambda c: F.struct(c["lang"].alias("lang"), c["topic"].alias("topic"), (c["tokens"] * F.try_element_at(F.col("b"), c["lang"]) * F.try_element_at(F.col("t"), c["topic"])).alias("w")))
        maps = [F.create_map(*[F.lit(x) for pair in factors[d].items() for x in pair]).cast("map<string, double>").alias(n) for d, n in (("lang", "b"), ("topic", "t"))]
        swept = profiles.select("goal", "held", *maps).select("goal", cell.alias("cells"))
        swept = swept.withColumn("all", F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["w"])).where("all > 0").select(F.inline("cells"), (F.col("goal") / F.col("all")).alias("a"))
        table = {(r["lang"], r["topic"]): r["w"] for r in swept.groupBy("lang", "topic").agg(F.sum(F.col("w") * F.col("a")).alias("w")).collect()}
        moved = 0.0
        for k, d in enumerate(DIMS[1:]):
            now = dict.fromkeys(goals[d], 0.0)
            mass = sum(table.values())
            for pair, w in sorted(table.items()):
                now[pair[k]] += w / mass
            step = {g: goals[d][g] / now[g] if now[g] > 0 else 0.0 for g in goals[d]}
            moved = max([moved, *(abs(goals[d][g] - now[g]) for g in goals[d])])
            factors[d] = {g: factors[d][g] * step[g] for g in goals[d]}
            table = {pair: w / mass * step[pair[k]] for pair, w in table.items()}
            if not sum(table.values()):  # nothing is left that any target wants
                drop_table(spark, path)
                return cells.withColumn("weight", F.lit(0.0))
        if moved < close:
            break
        top = {d: max(f.values()) for d, f in factors.items()}
        factors = {d: {g: x / top[d] for g, x in f.items()} for d, f in factors.items()}
    else:
        warnings.warn(f"raking ended after {sweeps} sweeps: a group's share misses its target by up to {moved:.3g}", RuntimeWarning, stacklevel=2)
    part = F.col("tokens") * F.coalesce(_column(factors["lang"], "lang"), F.lit(0.0)) * F.coalesce(_column(factors["topic"], "topic"), F.lit(0.0))
    parts = cells.withColumn("part", part)
    of = parts.groupBy("source").agg(F.sum("part").alias("all")).join(profiles.select("source", "goal"), "source").select("source", F.try_divide("goal", "all").alias("a"))
    raked = parts.join(of, "source", "left").select(*DIMS, "tokens", F.coalesce(F.col("part") * F.col("a"), F.lit(0.0)).alias("weight"))
    raked, raked_path = write_table(raked, "raked")
    drop_table(spark, path)
    # the last step is that of the topics, as in every sweep; it is known from the sources' step alone
    now = {r["topic"]: r["w"] for r in raked.groupBy("topic").agg(F.sum("weight").alias("w")).collect()}
    last = {g: goals["topic"].get(g, 0.0) / w if w else 0.0 for g, w in now.items()}
    return raked.withColumn("weight", F.col("weight") * F.coalesce(_column(last, "topic"), F.lit(0.0)))


def _source_goals(profiles: DataFrame, wanted: Mapping[str, float] | None, damping: float, total: float) -> DataFrame:
    """The profiles with ``goal``, the target share of the source."""
    if wanted is None:
        goal = F.pow(F.col("tokens") / total, F.lit(damping))
    else:
        given = profiles.sparkSession.createDataFrame([(k, max(0.0, float(v))) for k, v in wanted.items()] or [(NONE, 0.0)], "given string, value double")
        profiles, goal = profiles.join(given, profiles["source"] == given["given"], "left"), F.coalesce("value", F.lit(0.0))
    out = profiles.select("source", "held", goal.alias("goal"))
    mass, n = out.agg(F.sum("goal"), F.count(F.lit(1))).first()
    return out.withColumn("goal", F.col("goal") / mass if mass else F.lit(1 / max(n, 1)))


def probabilities(weighted: DataFrame, keep: float) -> DataFrame:
    """(source, lang, topic, weight, probability): expected tokens are ``keep`` of all, as far as weights above 0 allow.

    What is expected grows with c in straight pieces that bend down where a cell is kept
    whole, so a step from the left never passes the answer and ends in finitely many.
    """
    budget = keep * float(weighted.agg(F.sum("tokens")).first()[0] or 0)
    rate = F.coalesce(F.try_divide("weight", "tokens"), F.lit(0.0))
    c = 0.0
    while True:
        whole = (F.col("weight") > 0) & (F.lit(c) * rate >= 1)
        full, open_ = weighted.agg(F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~whole, F.col("weight"))), F.lit(0.0))).first()
        if open_ <= 0 or (new := max(c, (budget - full) / open_)) <= c * (1 + 1e-12):
            break
        c = new
    return weighted.select(*DIMS, "weight", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), c * rate)).otherwise(1.0).alias("probability"))


def draw_mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mixture keeps, with all their columns."""
    id_col = options.get("id_col", "doc_id")
    (gone_id,) = fresh(docs, "gone")
    gone = mix(docs, **options).groupBy(F.col(id_col).alias(gone_id)).agg(F.max("kept").alias("stays")).where(~F.col("stays")).select(gone_id)
    gone, path = write_table(gone, "not-drawn")
    return docs.join(sized(gone, path), docs[id_col].eqNullSafe(gone[gone_id]), "left_anti")
