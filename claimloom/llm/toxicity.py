"""Toxicity: maximum-scoring segments over token log-odds, with extreme-value calibration.

Words and word beginnings of 4, 5 and 6 letters are counted in distinct labelled texts,
once a text.  Their log-odds take a Dirichlet prior: a flat part and one in proportion to
their frequency in both classes; those that stand out are kept, everything else scores a
small penalty.  A word takes its own log-odds, or those of its longest kept beginning.  A
linear-time scan finds every maximal segment of a text.

Segments of clean text obey an extreme-value law: a segment of score s in n words has the
excess x = slope * s - log(n) - shift, and the chance of one so good is 1 - exp(-exp(-x)).
All segments of a text that reach above the law's middle are aggregated by the law of
sums: the r best together have the chance exp(-T) * T ** (r - 1) / (r! (r - 1)!), where T
is the sum of their excesses; that is weighted by 2 ** -r for the choice of r, and the
most telling r counts.  A logistic curve fitted on the sample turns it into a probability.

The fit is bounded by ``most`` labelled documents by hash (``labelled_sample``); all their
terms count.

Defined cases: a null or blank text has no segment and gets the score of a text without
evidence; texts of any length are scanned whole; without labelled documents all scores are
0.5; segments of equal score keep their order in the text; repeated rows are each answered,
with null ids as well; an empty table gives an empty result; further columns of the input
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, labelled_sample, sized, sliced, write_table

_WORD = re.compile(r"[^\W\d_]+")
_HEADS = (6, 5, 4)


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def segments(scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, end, score), in one scan from left to right.

    Scores are walked from one positive entry to the next: what lies between is one drop.
    Each candidate keeps the total before and after it and joins those on its left while
    their start is lower and its end higher.
    """
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list[float]] = []  # first, end, total before, total after, nearest on the left with a lower total before
    for at in places.tolist():
        first, before, after = at, total[at], total[at + 1]
        k = len(stack) - 1
        while k >= 0:
            while k >= 0 and stack[k][2] >= before:
                k = int(stack[k][4])
            if k < 0 or stack[k][3] >= after:
                break
            first, before = int(stack[k][0]), stack[k][2]
            del stack[k:]
            k = len(stack) - 1
        stack.append([first, at + 1, before, after, k])
    return [(int(a), int(b), float(y - x)) for a, b, x, y, _ in stack]


class ToxicityModel:
    def __init__(self, weights: dict[str, float], drift: float, slope: float, shift: float, curve: tuple[float, float]):
        self.weights, self.drift, self.slope, self.shift, self.curve = weights, drift, slope, shift, curve
        self._seen: dict[str, float] = {}

    def word_score(self, word: str) -> float:
        if (own := self.weights.get(word)) is not None:
            return own
        for k in _HEADS:
            if len(word) > k and (own := self.weights.get(word[:k] + "*")) is not None:
                return own
        return -self.drift

    def word_scores(self, text: str) -> np.ndarray:
        words = tokens(text)
        if len(self._seen) > 150_000:
            self._seen.clear()
        seen = self._seen
        for w in set(words).difference(seen):
            seen[w] = self.word_score(w)
        return np.fromiter(map(seen.__getitem__, words), np.float64, len(words))

    def excess(self, best: float, words: int) -> float:
        return self.slope * best - np.log(max(words, 1)) - self.shift

    def evidence(self, found: list[float], words: int) -> float:
        """Minus the log of the chance that clean text of so many words has segments as good as these."""
        return sum_evidence([self.excess(s, words) for s in found] or [self.excess(0.0, words)])

    def score(self, text: str) -> float:
        words = self.word_scores(text)
        return self.probability(self.evidence([s for _, _, s in segments(words, self.drift)], len(words)))

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * evidence, -40, 40))))


def sum_evidence(excesses: list[float]) -> float:
    """The best of -log(2 ** (1 - r) * chance of the r best), over the r to which the law of sums applies."""
    ordered = sorted(excesses, reverse=True)
    best = total = ordered[0]
    for r, x in enumerate(ordered[1:], 2):
        total += x
        if x <= 0 or total < r * (r + 1):  # the law is one of the far tail
            break
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
    return best


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        both = Counter(), Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(tokens(text or ""))
            both[y > 0].update(words | {w[:k] + "*" for w in words for k in _HEADS if len(w) > k})
            both[y > 0][""] += len(words)
        terms = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([both[0][t] for t in terms], pa.int64()), pa.array([both[1][t] for t in terms], pa.int64())], ["term", "clean", "toxic"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", mod: int = 5, held: int = 0, most: int = 20_000, prior: float = 500.0, deviations: float = 3.5, drift: float = 0.25) -> ToxicityModel:
    sample, sample_path = write_table(labelled_sample(docs, labels, label, mod, held, most).dropDuplicates(["text", "y"]), "toxicity-sample")
    counts, counts_path = write_table(sample.mapInArrow(_count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-terms")
    n0, n1 = next(((float(r[0]), float(r[1])) for r in counts.where("term = ''").select("clean", "toxic").collect()), (0.0, 0.0))
    weights: dict[str, float] = {}
    if n0 and n1:
        alpha = F.lit(0.5) + F.lit(prior) * (F.col("clean") + F.col("toxic")) / (n0 + n1)
        a1, a0 = F.col("toxic") + alpha, F.col("clean") + alpha
        odds = F.log(a1 / (n1 + prior - a1)) - F.log(a0 / (n0 + prior - a0))
        strong = counts.where("term <> '' AND clean + toxic >= 4").select("term", odds.alias("odds"), (odds / F.sqrt(1 / a1 + 1 / a0)).alias("z"))
        strong = strong.where(F.abs("z") >= deviations)  # terms of at most ``most`` texts
        weights = {r["term"]: r["odds"] - drift if r["odds"] > 0 else min(r["odds"], -drift) for r in strong.collect()}
    bare = ToxicityModel(weights, drift, 1.0, 0.0, (0.0, 0.0))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text in batch.column(0).to_pylist():
                scores = bare.word_scores(text or "")
                up = scores[scores > 0]
                rows.append((float(len(scores)), float(len(up)), float(up.sum()), [s for _, _, s in segments(scores, drift)]))
            kinds = [pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds))], ["y", "n", "ups", "up", "found"])

    rows = sample.mapInArrow(scan, "y int, n double, ups double, up double, found array<double>").toPandas()
    drop_table(docs.sparkSession, sample_path)
    drop_table(docs.sparkSession, counts_path)
    if not rows["y"].nunique() > 1:
        return ToxicityModel({}, drift, 1.0, 0.0, (0.0, 0.0))
    rows = rows.assign(best=[max(x, default=0.0) for x in rows["found"]]).sort_values(["y", "best", "n", "ups", "up"])  # the order changes no sum
    clean = rows[rows["y"] == 0]
    slope = _slope(float(clean["ups"].sum()), float(clean["up"].sum()), float(clean["n"].sum()), drift)
    shift = float((slope * clean["best"] - np.log(np.maximum(clean["n"], 1))).mean() - np.euler_gamma)
    model = ToxicityModel(weights, drift, slope, shift, (0.0, 0.0))
    x = np.array([model.evidence(list(found), int(n)) for found, n in zip(rows["found"], rows["n"], strict=True)])
    model.curve = _logistic(x, rows["y"].to_numpy(np.float64))
    return model


def _slope(ups: float, up: float, n: float, drift: float) -> float:
    """The positive root of the extreme-value law: rises of their mean size, drops by the drift."""
    p = (ups + 0.5) / (n + 1)
    size = (up + 1) / (ups + 1)
    low, high = 1e-3, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p * np.exp(min(mid * size, 600)) + (1 - p) * np.exp(-mid * drift) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for y ~ a + b * x with a small ridge."""
    middle, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([np.ones(len(x)), (x - middle) / scale], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, z.T @ (y - p) - 0.05 * w), -3, 3)
    return float(w[0] - w[1] * middle / scale), float(w[1] / scale)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", level: float = 0.01) -> DataFrame:
    """One row per input row: id, score, passages (first word, end, chance in clean text) whose chance is below ``level``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                words = model.word_scores(text or "")
                found = segments(words, model.drift)
                scores.append(model.probability(model.evidence([s for _, _, s in found], len(words))))
                chance = ((x, y, float(-np.expm1(-np.exp(-np.clip(model.excess(s, len(words)), -30, 700))))) for x, y, s in found)
                passages.append([{"first": x, "end": y, "chance": c} for x, y, c in chance if c < level])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(passages, kind)], [id_col, "score", "passages"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"`{id_col}` long, score double, passages array<struct<first: int, end: int, chance: double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; rows that repeat an id go together.

    A model that had no labels of both kinds to learn from knows nothing, and drops nothing.
    """
    if model.curve == (0.0, 0.0):
        return docs
    gone = score_toxicity(docs, model, id_col=id_col, text_col=text_col).where(F.col("score") >= threshold).select(F.col(id_col).alias(fresh(docs, "gone")[0])).distinct()
    gone, path = write_table(gone, "toxic")
    return docs.join(sized(gone, path), docs[id_col].eqNullSafe(gone[gone.columns[0]]), "left_anti")
