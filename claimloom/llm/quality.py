"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin, and the score is the logistic of a sum of
lookup tables: one per feature, and one per chosen pair of features.  The tables are
learnt by cyclic boosting: round after round, each feature in turn gets a shallow tree
on its bins, fitted to the gradients of the logistic loss; then the pairs with the most
to gain get trees of one cut per feature in the same way.

The fit is bounded by ``most`` labelled documents, chosen by hash (``labelled_sample``).

Defined cases: a null text counts as empty and gets a score like any other; texts of any
length are read whole, one at a time; without a labelled document all scores are 0.5; equal
gains go to the first cut and the first pair; repeated rows are each answered, with null
ids as well; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, sliced

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "stops", "odd_marks", "bars", "line_bytes",
    "lines_repeated", "words_distinct", "pairs_distinct", "packed", "not_ascii", "marked_words", "top_word", "line_ends", "mark_runs", "near_distinct",
)
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STOPS, _ODD = b".,;:", b"!#$%&*@^~|<>=_\\{}[]"
_HIGH = bytes(range(128, 256))
#: Words that end in an odd mark, and runs of one mark.
_MARKED = re.compile(rb"[" + re.escape(_ODD) + rb"](?!\S)")
_RUNS = re.compile(rb"([" + re.escape(_MARKS) + rb"])\1+")


def features(text: bytes) -> list[float]:
    """All of them read the whole text."""
    size = len(text)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    bare = len(text.translate(None, _MARKS))
    rest = lambda chars: (size - len(text.translate(None, chars))) / max(size, 1)
    counts = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    fresh = sum(len(set(words[k : k + 100])) for k in range(0, n, 100))
    return [
        np.log1p(size), np.log1p(n), size / max(n, 1), rest(_UPPER), rest(_DIGITS), (size - bare) / max(size, 1), rest(_STOPS), rest(_ODD), text.count(b"|") / max(n, 1),
        np.log1p(size / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1), len(counts) / max(n, 1), len(pairs) / max(n - 1, 1), len(zlib.compress(text, 1)) / max(size, 1), rest(_HIGH),
        len(_MARKED.findall(text)) / max(n, 1), max(counts.values(), default=0) / max(n, 1), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(len(lines), 1),
        len(_RUNS.findall(text)) / max(n, 1), fresh / max(n, 1),
    ]


class AdditiveModel:
    """Bins, lookup tables and pairs of lookup tables."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 150, pairs: int = 6, rate: float = 0.1, ridge: float = 4.0):
        width = x.shape[1] if x.ndim == 2 else 0
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base = np.log(share / (1 - share))
        if not len(y):
            return
        binned = self.bin(x)
        margin = np.full(len(y), self.base)
        for _ in range(rounds):
            for j, table in enumerate(self.tables):
                grad, weight = self._slopes(y, margin)
                step = rate * _line_tree(np.bincount(binned[j], grad, len(table)), np.bincount(binned[j], weight, len(table)), ridge)
                table += step
                margin += step[binned[j]]
        grad, weight = self._slopes(y, margin)
        gains = sorted((-_square_tree(*self._grid(binned, i, j, grad, weight), ridge)[1], i, j) for i, j in combinations(range(width), 2))
        self.pairs = [(i, j, np.zeros((len(self.tables[i]), len(self.tables[j])))) for _, i, j in gains[:pairs]]
        for _ in range(rounds // 3):
            for i, j, table in self.pairs:
                grad, weight = self._slopes(y, margin)
                step = rate * _square_tree(*self._grid(binned, i, j, grad, weight), ridge)[0]
                table += step
                margin += step[binned[i], binned[j]]

    @staticmethod
    def _slopes(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    def _grid(self, binned, i, j, grad, weight):
        shape = len(self.tables[i]), len(self.tables[j])
        cell = binned[i] * shape[1] + binned[j]
        return np.bincount(cell, grad, shape[0] * shape[1]).reshape(shape), np.bincount(cell, weight, shape[0] * shape[1]).reshape(shape)

    def bin(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self.bin(x)
        margin = np.full(len(x), self.base)
        for own, table in zip(binned, self.tables, strict=True):
            margin += table[own]
        for i, j, table in self.pairs:
            margin += table[binned[i], binned[j]]
        return 1 / (1 + np.exp(-margin))


def _line_tree(grad: np.ndarray, weight: np.ndarray, ridge: float, cuts: int = 3) -> np.ndarray:
    """Leaf values per bin of a tree with at most ``cuts`` cuts, grown best first."""
    g, w = np.concatenate(([0], np.cumsum(grad))), np.concatenate(([0], np.cumsum(weight)))
    leaves = [(0, len(grad))]
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + ridge)
    for _ in range(cuts):
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(leaves):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                if (top := gain.max()) > best[0]:
                    best = (top, k, int(at[gain.argmax()]))
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in leaves:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + ridge)
    return out


def _square_tree(grad: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """(leaf values per cell, gain) of the best tree with one cut along each side."""
    if min(grad.shape) < 2:
        return np.zeros(grad.shape), 0.0
    g, w = grad.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    parts = []
    for s in (g, w):
        a = s[:-1, :-1]
        parts.append((a, s[:-1, -1:] - a, s[-1:, :-1] - a, s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + a))
    gain = sum(x**2 / (y + ridge) for x, y in zip(*parts, strict=True))
    r, c = np.unravel_index(gain.argmax(), gain.shape)
    leaf = [x[r, c] / (y[r, c] + ridge) for x, y in zip(*parts, strict=True)]
    out = np.empty(grad.shape)
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = leaf
    return out, float(gain[r, c])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([features(t or b"") for t in column.cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", mod: int = 5, held: int = 0, most: int = 20_000) -> AdditiveModel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(_matrix(batch.column(0))), pa.list_(pa.float64()))], ["y", "x"])

    rows = labelled_sample(docs, labels, label, mod, held, most).mapInArrow(run, "y int, x array<double>").toPandas()
    rows = rows.assign(key=[tuple(x) for x in rows["x"]]).sort_values(["key", "y"])  # the order of rows changes no sum
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel(x, rows["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: AdditiveModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            score = model.score(_matrix(batch.column(1))) if model.edges else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], [id_col, "score"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"`{id_col}` long, score double")
