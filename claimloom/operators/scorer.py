"""A trained scorer of texts: softmax regression over hashed words and word pairs.

Texts become sparse rows of hashed features once; each round of the fit is one Spark pass that
gives back the sum of the gradient by class and bucket, at most classes x buckets rows however
many texts there are.  Steps are AdaGrad's, from zero weights, so a fit depends on its rows alone
(but for the order in which floats are added).  A fitted model is a table on disk and a small
object in memory that goes to each worker once.

Defined cases: null texts and labels are not learnt from; a null text has no score; a text
without words has the classes' base rates; without rows to learn from all classes score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts whose features are held at once.
ROWS_AT_ONCE = 200

_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


def _shape(word: str) -> str:
    """How a word is written, and its length up to 12."""
    form = "0" if word.isdigit() else "a" if word.islower() else "A" if word.isupper() else "T" if word.isalpha() else word if len(word) == 1 else "x"
    return f"{form}{min(len(word), 12)}"


def hashed(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text: logarithms of counts of words, word pairs, shapes and shape pairs, of length 1; bucket 0 is the base rate."""
    found = _WORD.findall(text)
    words, shapes = [w.lower() for w in found], [f"\t{_shape(w)}" for w in found]
    pairs = [" ".join(x) for row in (words, shapes) for x in zip(row, row[1:], strict=False)]
    at = np.fromiter((zlib.crc32(x.encode()) for x in (*words, *shapes, *pairs)), np.int64) % ((1 << bits) - 1) + 1
    at, n = np.unique(at, return_counts=True)
    weight = np.log1p(n)
    return np.append(0, at), np.append(1.0, weight / max(1e-12, float(np.sqrt((weight**2).sum()))))


@dataclass
class Softmax:
    """``weights`` has a row for each of ``classes`` and a column for each bucket."""

    classes: tuple[str, ...]
    bits: int
    weights: np.ndarray

    def scores(self, texts: list[str]) -> list[np.ndarray]:
        return [self.weights[:, at] @ value for at, value in (hashed(t, self.bits) for t in texts)]

    def loader(self, spark: SparkSession) -> Callable[[], Callable[[list[str]], list]]:
        """What ``classify.two_stage`` takes: each worker gets the weights once."""
        held = spark.sparkContext.broadcast(self)  # classes x buckets, whatever the corpus
        return lambda: held.value.scores

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, name, self.bits, w.astype("<f8").tobytes()) for k, (name, w) in enumerate(zip(self.classes, self.weights, strict=True))]
        spark.createDataFrame(rows, "ord int, class string, bits int, weights binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Softmax:
    rows = spark.read.parquet(path).orderBy("ord").collect()  # one row per class
    return Softmax(tuple(r["class"] for r in rows), rows[0]["bits"], np.stack([np.frombuffer(r["weights"], "<f8") for r in rows]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of long rows would be many times larger on its way; features are made and summed some rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


def _featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            made = [hashed(t, bits) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float64()))], ["y", "at", "value"])

    return run


def _gradient(weights: np.ndarray, share: np.ndarray):
    k, size = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size))
        for batch in _pieces(batches):
            y, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            value, place = batch.column(2).flatten().to_numpy(), at.flatten().to_numpy()
            row = np.repeat(np.arange(len(y)), np.diff(at.offsets.to_numpy()))
            scores = np.stack([np.bincount(row, w[place] * value, len(y)) for w in weights])
            p = np.exp(scores - scores.max(0))
            p /= p.sum(0)
            p[y, np.arange(len(y))] -= 1
            p *= share[y]
            for c in range(k):
                total[c] += np.bincount(place, p[c][row] * value, size)
        c, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(at), pa.array(total[c, at])], ["c", "at", "g"])

    return run


def fit(texts: DataFrame, text: str, label: str, classes: tuple[str, ...], *, bits: int = 14, rounds: int = 20, rate: float = 0.5, decay: float = 1e-4, most: int | None = None) -> Softmax:
    """Learns ``label`` (one of ``classes``) from all rows, or from ``most`` of them by hash of their text.

    Each class counts as much as any other, however few rows it has.
    ``texts`` is turned into features once and checkpointed, so the session needs a checkpoint folder.
    """
    rows = texts.where(F.col(text).isNotNull() & F.col(label).cast("string").isin(list(classes)))
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")) - 1
    rows = rows.select(y.cast("int").alias("y"), F.col(text).alias("text"))
    if most is not None:
        rows = rows.orderBy(F.xxhash64("text"), "y").limit(most)
    table = rows.mapInArrow(_featured(bits), "y int, at array<int>, value array<double>").checkpoint()
    counts = {r["y"]: r["n"] for r in table.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    n = sum(counts.values())
    share = np.array([n / (len(counts) * counts[c]) if c in counts else 0.0 for c in range(len(classes))])
    weights = np.zeros((len(classes), 1 << bits))
    squares = np.full_like(weights, 1e-8)
    for _ in range(rounds if n else 0):
        sums = table.mapInArrow(_gradient(weights, share), "c int, at long, g double").groupBy("c", "at").agg(F.sum("g").alias("g")).collect()
        step = decay * weights
        step[[r["c"] for r in sums], [r["at"] for r in sums]] += np.array([r["g"] for r in sums]) / n
        squares += step**2
        weights = weights - rate * step / np.sqrt(squares)
    return Softmax(tuple(classes), bits, weights)
