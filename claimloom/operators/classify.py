"""Matching texts to taxonomy labels, and the two-stage gate over model scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import RDF, SKOS
from ..functions.text import STOP_WORDS, clean_tokens, first_max, jaccard, last_of, window
from .concepts import place

#: The classes of the second model, by index.
CLASS_LABELS = ("1_1", "1_2", "1_3", "1_4", "1_6", "1_7", "2_1", "2_3", "3_1", "3_2", "3_3", "4_1", "4_2", "4_4", "4_5", "5_1", "5_2", "5_3")
NEGATIVE = "0"
#: Labels are broadcast up to so many bytes of text; a larger taxonomy is joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Texts that share one token are dealt to so many rows a share in a join with a threshold.
SHARE_ROWS = 20_000
#: Common tokens and pairs that are held at once while texts are compared with all labels.
PAIRS_AT_ONCE = 2_000_000


def taxonomy(triples: DataFrame, scheme: str | None = None) -> DataFrame:
    """(id, url, label, parent_id, ord) of the concepts of a SKOS graph; ``ord`` sorts them as a taxonomy lists them.

    One grouped pass over the triples instead of a self-join per predicate.
    """
    named = triples.where(F.col("p").isin(RDF + "type", SKOS + "inScheme", SKOS + "prefLabel", SKOS + "broader"))
    of = lambda p: F.col("p") == p
    rows = named.groupBy("s").agg(
        F.max(of(RDF + "type") & (F.col("o") == SKOS + "Concept")).alias("concept"),
        F.max(of(SKOS + "inScheme") & ((F.col("o") == scheme) if scheme else F.lit(True))).alias("inside"),
        F.min(F.when(of(SKOS + "prefLabel"), F.col("o"))).alias("label"),
        F.min(F.when(of(SKOS + "broader"), F.col("o"))).alias("parent"),
    )
    rows = rows.where("concept AND inside AND label IS NOT NULL")
    return rows.select(last_of(F.col("s"), "#").alias("id"), F.col("s").alias("url"), "label", last_of(F.col("parent"), "#").alias("parent_id"), place(last_of(F.col("s"), "#")).alias("ord"))


def _sets(rows: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """The rows with ``t``, the tokens of their ``text``; the explode keeps them from being made once for each use."""
    return rows.withColumn("t", F.explode(F.array(tokens(F.col("text"))))).drop("text")


def _exploded(sets: DataFrame, *keep: str, size: str) -> DataFrame:
    return sets.select(*keep, F.size("t").alias(size), F.explode("t").alias("token"))


def _few(labels: DataFrame, label: str) -> bool:
    """Whether the labels may be broadcast, by their bytes."""
    text = F.col(label).cast("string")
    return labels.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES


class _Index:
    """Labels by token: which labels hold each token, and how many tokens each label has."""

    def __init__(self, labels: list):
        own = [(token, k) for k, tokens in enumerate(labels) for token in tokens]
        self.sizes = np.array([len(tokens) for tokens in labels], np.int64)
        self.words = pa.array(sorted({token for token, _ in own}), pa.string())
        code = pc.index_in(pa.array([token for token, _ in own], pa.string()), value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.holders = np.array([k for _, k in own], np.int64)[np.argsort(code, kind="stable")]
        self.starts = np.append(0, np.cumsum(np.bincount(code, minlength=len(self.words)))).astype(np.int64)

    def similarities(self, tokens: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, its and the next rows' similarity to every label), so many rows at a time as fit PAIRS_AT_ONCE."""
        n, labels = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64), len(self.sizes)
        found = pc.index_in(tokens.flatten().cast(pa.string()), value_set=self.words)
        row = np.repeat(np.arange(len(n)), n)[found.is_valid().to_numpy(zero_copy_only=False)]
        code = found.drop_null().to_numpy().astype(np.int64)
        each = self.starts[code + 1] - self.starts[code]
        before = np.append(0, np.cumsum(np.bincount(row, each, len(n)).astype(np.int64) + labels))
        first = 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(before, before[first] + PAIRS_AT_ONCE, "right")) - 1)
            a, b = np.searchsorted(row, (first, last))
            much = each[a:b]
            place = np.repeat(self.starts[code[a:b]] - np.append(0, np.cumsum(much))[:-1], much) + np.arange(much.sum())
            both = np.bincount(np.repeat(row[a:b] - first, much) * labels + self.holders[place], minlength=(last - first) * labels).reshape(last - first, labels)
            either = n[first:last, None] + self.sizes - both
            yield first, both / np.maximum(either, 1)
            first = last


def _compared(texts: DataFrame, labels: DataFrame, key: str, text: str, label_id: str, label: str, order: str, tokens: Callable[[Column], Column], made: Callable, *shown: str) -> DataFrame:
    """The key and what ``made(similarities, labels)`` gives of some texts: their places among these and the columns ``shown``.

    The labels are few and go to every task whole; no token becomes a row, common ones are counted in arrays, text by text.
    """
    few = labels.select(F.col(label_id).alias("label_id"), F.col(order).alias("ord"), F.col(label_id).cast("string").alias("category"), tokens(F.col(label)).alias("t"))
    rows = few.orderBy("ord", "label_id").collect()  # BROADCAST_BYTES at most
    columns = {c: pa.array([r[c] for r in rows], to_arrow_type(few.schema[c].dataType)) for c in ("label_id", "ord", "category")}
    held = texts.sparkSession.sparkContext.broadcast((_Index([r["t"] or () for r in rows]), columns))
    schema = StructType([StructField("key", texts.schema[key].dataType), *(few.schema[c] for c in shown), StructField("similarity", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, listed = held.value
        for batch in batches:
            for first, found in index.similarities(batch.column(1)):
                at, *values = made(found, listed)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + at)), *values], schema.names)

    words = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    return texts.select(F.col(key).alias("key"), words.alias("t")).mapInArrow(run, schema)


def _pairs(every: bool) -> Callable:
    def made(found: np.ndarray, labels: dict) -> tuple:
        text, label = np.nonzero(np.ones_like(found) if every else found)
        return text, labels["label_id"].take(pa.array(label)), labels["ord"].take(pa.array(label)), pa.array(found[text, label])

    return made


def _best(least: float) -> Callable:
    def made(found: np.ndarray, labels: dict) -> tuple:
        text = np.arange(len(found))
        if not found.shape[1]:
            return text, pa.array([NEGATIVE] * len(text), pa.string()), pa.array(np.zeros(len(text)))
        first = found.argmax(1)  # the labels are in order
        most = found[text, first]
        names = pc.if_else(pa.array((most >= least) & (most > 0)), labels["category"].take(pa.array(first)), pa.scalar(NEGATIVE))
        return text, names, pa.array(most)

    return made


def scores(texts: DataFrame, labels: DataFrame, key: str, text: str, label_id: str, label: str, order: str, tokens: Callable[[Column], Column] = clean_tokens) -> DataFrame:
    """(key, label_id, ord, similarity) of texts and labels with a common token: an inverted index.

    Few labels go to every task with their index; many are joined by token.
    """
    if _few(labels, label):
        return _compared(texts, labels, key, text, label_id, label, order, tokens, _pairs(False), "label_id", "ord")
    left = _exploded(_sets(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), tokens), "key", size="n")
    right = _exploded(_sets(labels.select(F.col(label_id).alias("label_id"), F.col(order).alias("ord"), F.col(label).alias("text")), tokens), "label_id", "ord", size="m")
    both = left.join(right, "token").groupBy("key", "n", "label_id", "ord", "m").agg(F.count(F.lit(1)).alias("k"))
    return both.select("key", "label_id", "ord", (F.col("k").cast("double") / (F.col("n") + F.col("m") - F.col("k")).cast("double")).alias("similarity"))


def similar(texts: DataFrame, labels: DataFrame, key: str, text: str, label_id: str, label: str, order: str, least: float, tokens: Callable[[Column], Column] = clean_tokens) -> DataFrame:
    """(key, label_id, ord, similarity) of texts and labels at least so similar (over 0): all such pairs, few others on the way.

    The tokens of a set are ordered by the pairs that they would make, counted on both sides; a token of one side alone makes
    none and comes first.  Two sets of n and m tokens can reach ``least`` only if they share one of the first n - ceil(least n) + 1
    and m - ceil(least m) + 1 and if least n <= m <= n / least; such pairs are compared whole.  Where very many texts share
    a token, they are dealt to shares, and its labels go to each.  Empty sets are similar to nothing; ids may repeat or be null,
    and repeated rows with one id give one row.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity is over 0 and at most 1; use scores() for all that share a token")
    left = _sets(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), tokens).withColumn("th", F.xxhash64("t"))
    right = _sets(labels.select(F.col(label_id).alias("label_id"), F.col(order).alias("ord"), F.col(label).alias("text")), tokens).withColumn("lh", F.xxhash64("t"))
    lefts, rights = _exploded(left, "key", "th", size="n"), _exploded(right, "label_id", "ord", "lh", size="m")
    shortest, longest = rights.agg(F.min("m"), F.max("m")).first()  # two numbers
    lefts = lefts.where(F.col("n").between((shortest or 0) * least - 1e-9, (longest or 0) / least + 1e-9))
    often = lefts.groupBy("token").agg(F.count(F.lit(1)).alias("nl")).join(rights.groupBy("token").agg(F.count(F.lit(1)).alias("nr")), "token")

    def prefixes(rows: DataFrame, size: str, *keep: str) -> DataFrame:
        met = rows.join(often, "token").groupBy(*keep, size).agg(F.sort_array(F.collect_set(F.struct((F.col("nl") * F.col("nr")).alias("pairs"), "token", "nl"))).alias("xs"))
        alone = F.col(size) - F.size("xs")
        some = F.slice("xs", 1, F.greatest(F.col(size) - F.ceil(F.col(size) * least - 1e-9) + 1 - alone, F.lit(0)).cast("int"))
        return met.select(*keep, size, F.explode(some).alias("x")).select(*keep, size, "x.token", F.ceil(F.col("x.nl") / SHARE_ROWS).cast("int").alias("shares"))

    one = prefixes(lefts, "n", "key", "th").withColumn("share", F.pmod(F.xxhash64("key", "th"), F.col("shares")).cast("int")).drop("shares")
    other = prefixes(rights, "m", "label_id", "ord", "lh").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    fits = (F.col("m") >= F.col("n") * least - 1e-9) & (F.col("n") >= F.col("m") * least - 1e-9)
    tried = one.join(other, ["token", "share"]).where(fits).select("key", "th", "label_id", "ord", "lh").distinct()
    left = left.select(F.col("key").alias("key2"), F.col("th").alias("th2"), F.col("t").alias("tt")).distinct()
    right = right.select(F.col("label_id").alias("label_id2"), F.col("ord").alias("ord2"), F.col("lh").alias("lh2"), F.col("t").alias("lt")).distinct()
    whole = tried.join(left, F.col("key").eqNullSafe(F.col("key2")) & (F.col("th") == F.col("th2")))
    whole = whole.join(right, F.col("label_id").eqNullSafe(F.col("label_id2")) & F.col("ord").eqNullSafe(F.col("ord2")) & (F.col("lh") == F.col("lh2")))
    whole = whole.select("key", "label_id", "ord", jaccard(F.col("tt"), F.col("lt")).alias("similarity"))
    return whole.where(F.col("similarity") >= least).distinct()


def all_scores(texts: DataFrame, labels: DataFrame, key: str, text: str, label_id: str, label: str, order: str, tokens: Callable[[Column], Column] = clean_tokens) -> DataFrame:
    """The same for every pair, 0 included: for small label sets and thresholds of 0.

    The labels are broadcast, and their bytes are checked first.
    """
    if not _few(labels, label):
        raise ValueError("too many labels to compare every text with each; use scores()")
    return _compared(texts, labels, key, text, label_id, label, order, tokens, _pairs(True), "label_id", "ord")


def best_match(texts: DataFrame, labels: DataFrame, key: str, text: str, label_id: str, label: str, order: str, least: float = 0.25, tokens: Callable[[Column], Column] = clean_tokens, below: bool = True) -> DataFrame:
    """(key, category, similarity): the most similar label, the earliest on ties; "0" below ``least``.

    Without ``below`` the similarity is 0 where no label reaches ``least``, and only pairs that may reach it are compared.
    """
    if (below or least <= 0) and _few(labels, label):
        return _compared(texts, labels, key, text, label_id, label, order, tokens, _best(least), "category")
    scored = scores(texts, labels, key, text, label_id, label, order, tokens) if below or least <= 0 else similar(texts, labels, key, text, label_id, label, order, least, tokens)
    # a window keeps the first row of each partition before the shuffle; an aggregate of structs would sort all rows
    first = Window.partitionBy("key").orderBy(F.col("similarity").desc(), "ord", "label_id")
    best = scored.withColumn("place", F.row_number().over(first)).where("place = 1").select("key", F.struct("label_id", "similarity").alias("b"))
    out = texts.select(F.col(key).alias("key")).join(best, "key", "left")
    similarity = F.coalesce("b.similarity", F.lit(0.0))
    found = F.when((similarity >= least) & (similarity > 0), F.col("b.label_id").cast("string")).otherwise(NEGATIVE)
    return out.select("key", found.alias("category"), similarity.alias("similarity"))


def gate(binary: Column, classes: Column, names: tuple[str, ...] = CLASS_LABELS) -> Column:
    """The class with the first highest score where the first model says yes, else "0"."""
    return F.when(first_max(binary) == 0, NEGATIVE).otherwise(F.element_at(F.array(*[F.lit(x) for x in names]), first_max(classes) + 1))


def two_stage(texts: DataFrame, text: str, binary: Callable[[], Callable[[list[str]], list]], classes: Callable[[], Callable[[list[str]], list]], size: int | None = 256, names: tuple[str, ...] = CLASS_LABELS) -> DataFrame:
    """Adds ``category``; the second model sees only texts that pass the first.

    ``binary`` and ``classes`` load a model and return a function from texts to scores;
    each worker loads once, and batches go through whole.  They see the first ``size``
    characters, or whole texts without a size; ``names`` are the classes of the second.
    """

    def scorer(load):
        @pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                out = pd.Series([None] * len(batch), dtype=object)
                there = batch.notna().to_numpy()
                if there.any():
                    out[there] = pd.Series([list(map(float, x)) for x in model(batch[there].tolist())], index=out.index[there], dtype=object)
                yield out

        return run

    shown = F.col(text) if size is None else window(F.col(text), size)
    seen = texts.withColumn("_binary", scorer(binary)(shown))
    passed = F.when(first_max(F.col("_binary")) != 0, shown)
    seen = seen.withColumn("_classes", scorer(classes)(passed))
    return seen.withColumn("category", F.when(F.col("_binary").isNotNull(), gate(F.col("_binary"), F.col("_classes"), names))).drop("_binary", "_classes")


def register_classify(spark: SparkSession, labels: DataFrame, least: float = 0.25, name: str = "classify_claim", most: int = 10_000) -> None:
    """A SQL function of that name from a text to the category of the most similar label, the earliest on ties.

    The labels, small by nature, go into the function; ``most`` bounds them.
    """
    rows = labels.select("id", clean_tokens(F.col("label")).alias("t")).orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many labels for a function; use best_match()")
    listed = F.array(*[F.struct(F.lit(r["id"]).alias("id"), F.array(*[F.lit(x) for x in r["t"]]).cast("array<string>").alias("t"), F.lit(-k).alias("rank")) for k, r in enumerate(rows)])
    spark.createDataFrame([("",)], "t string").select(listed.alias("labels")).createOrReplaceTempView(f"{name}_labels")
    words = "array_except(regexp_extract_all(lower(coalesce(txt, '')), '([\\\\p{L}]+)', 1), array(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "))"
    scored = "transform(labels, l -> struct(coalesce(try_divide(cast(size(array_intersect(w, l.t)) AS double), cast(size(w) + size(l.t) - size(array_intersect(w, l.t)) AS double)), 0.0D) AS s, l.rank AS r, l.id AS id))"
    best = f"SELECT array_max({scored}) AS b FROM (SELECT {words} AS w, (SELECT first(labels) FROM {name}_labels) AS labels)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(txt STRING) RETURNS STRING RETURN (SELECT CASE WHEN b.s >= {float(least)}D AND b.s > 0 THEN b.id ELSE '{NEGATIVE}' END FROM ({best}))")


def plain_category(category: Column) -> Column:
    """``0_0`` shown as ``0``."""
    return F.when(category == "0_0", "0").otherwise(category)
