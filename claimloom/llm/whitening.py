"""Embedding whitening: the leading principal components of a table of vectors, without its covariance matrix.

Entries become whole numbers on a fixed grid.  Block subspace iteration finds the components:
each Spark pass computes Xᵀ(XQ) on the centred rows for a narrow block Q, and gives back one
matrix of the block's size.  The driver orthonormalises what the passes have given (QR), takes
the Ritz pairs of that subspace, and goes on with the residuals of the leading ones until they
certify all components.  The subspace is kept from pass to pass and thinned to its Ritz vectors
once it is ``widest`` columns wide: on a flat spectrum, where plain iteration gains a seventh a
pass, this takes a few passes.  Nothing of the size dimensions x dimensions is formed on the executors.

Defined cases: rows whose vector is null or holds null or non-finite entries are left out;
vectors of several lengths, and entries too large for the grid (2**40 and more), are errors;
rows that repeat an id each count; a null id is an id; components whose variance is nothing
beside the largest (1e-10 of it) are left out, so fewer than asked for, or none, may come; an
empty table, or one of equal vectors, gives no component; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from .common import Scratch

#: A finer grid than the precision of stored vectors: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
_LARGEST = float(1 << 40)


@dataclass
class Whitening:
    """Components by falling variance: ``basis`` has one column each, ``variances`` their eigenvalues."""

    n: int
    sums: list[int]
    basis: np.ndarray
    variances: np.ndarray
    trace: float
    residuals: list[float] = field(default_factory=list)
    passes: int = 0
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.variances]

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis / np.sqrt(self.variances)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)**2, exact at every size."""
        if not len(x):
            return []
        gap = x.astype(object) * self.n - np.array(self.sums, object) if self.n * int(np.abs(x).max(initial=0)) >= 1 << 62 else x * self.n - np.array(self.sums, np.int64)
        if int(np.abs(gap).max(initial=0)) ** 2 * x.shape[1] >= 1 << 63:
            gap = gap.astype(object)
        return [int(v) for v in (gap * gap).sum(1)]


def _usable(vector: Column) -> Column:
    """No entry is null, NaN or infinite."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))


def on_grid(vector: Column) -> Column:
    def entry(c: Column) -> Column:
        c = c.cast("double")
        return F.when(F.abs(c) < _LARGEST, F.floor(c * SCALE) + SHIFT).otherwise(F.raise_error(F.lit("an entry is too large for the grid")).cast("long"))

    return F.transform(vector, entry)


def _grid_table(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.where(_usable(F.col(vector_col))).select(F.col(id_col).alias("id"), on_grid(F.col(vector_col)).alias("x"))


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def _summed(table: DataFrame, wide: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum over all rows of a matrix of fixed shape, which ``of`` gives for a block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + of(_matrix(batch.column(0), wide))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(total.tolist())], ["i", "v"])

    parts = table.select("x").mapInArrow(run, f"i int, v array<{kind}>")
    out = np.zeros(shape, np.int64 if kind == "long" else np.float64)
    for i, j, v in parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # shape[0] * shape[1] rows
        out[i, j] = v
    return out


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The block's directions that the basis lacks; columns that add nothing go."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-8] if len(block.T) else block
    return block


def fit_whitening(rows: DataFrame, components: int = 8, *, id_col: str = "vec_id", vector_col: str = "embedding", extra: int = 8, widest: int = 128, tol: float = 1e-13, most_passes: int = 500) -> Whitening:
    """The first ``components`` principal components over all usable rows.

    Every residual ||V u - e u|| is at most ``tol`` times the largest variance (or the
    subspace is the whole space), else this raises.  ``extra`` columns widen the block.
    """
    scratch = Scratch(rows.sparkSession)
    try:
        table = scratch.write(_grid_table(rows, id_col, vector_col), "whitening-rows")
        shape = table.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
        n, wide = shape["n"], shape["most"] or 0
        if shape["least"] != shape["most"]:
            raise ValueError(f"vectors of {shape['least']} to {shape['most']} entries; all must have as many")
        none = Whitening(n, [], np.zeros((wide, 0)), np.zeros(0), 0.0)
        if not n or not wide:
            return none
        none.sums = [int(s) for s in _summed(table, wide, (1, wide), lambda x: x.sum(0)[None, :], "long")[0]]
        return _iterate(table, none, wide, components, min(wide, components + extra), max(widest, 3 * (components + extra)), tol, most_passes)
    finally:
        scratch.drop()


def _iterate(table: DataFrame, fit: Whitening, wide: int, k: int, block: int, widest: int, tol: float, most_passes: int) -> Whitening:
    mean = fit.mean
    basis = np.zeros((wide, 0))
    image = np.zeros((wide, 0))  # of the basis under the covariance
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((wide, block)))[0]
    for fit.passes in range(1, most_passes + 1):

        def product(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            x = x - mean
            return np.hstack([x.T @ (x @ q), (x * x).sum(0)[:, None]])

        got = _summed(table, wide, (wide, q.shape[1] + 1), product) / fit.n
        fit.trace = float(got[:, -1].sum())
        if fit.trace == 0:
            return fit
        basis, image = np.hstack([basis, q]), np.hstack([image, got[:, :-1]])
        small = basis.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        ritz, ritz_image = basis @ y, image @ y
        left = ritz_image - ritz * values
        fit.residuals = [float(r) / float(values[0]) for r in np.linalg.norm(left[:, :k], axis=0)]
        whole = basis.shape[1] >= wide
        if whole or max(fit.residuals) <= tol and len(values) >= min(k, wide):
            keep = values[:k] > 1e-10 * values[0]
            fit.basis = np.linalg.qr(ritz[:, :k])[0][:, keep]
            fit.variances = values[:k][keep]
            break
        if basis.shape[1] + block > widest:  # thinned to the leading Ritz vectors
            held = k + block
            basis, image = ritz[:, :held], ritz_image[:, :held]
        q = _orthonormal(left[:, :block], basis)
        if not q.shape[1]:  # the subspace maps into itself: look outside of it
            q = _orthonormal(np.random.default_rng(fit.passes).standard_normal((wide, min(block, wide - basis.shape[1]))), basis)
    else:
        raise RuntimeError(f"after {most_passes} passes the largest residual is {max(fit.residuals):.2g} of the largest variance")
    wide_k = fit.basis.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        w = fit.project(x)
        return np.hstack([w.T @ w, w.sum(0)[:, None]])

    if wide_k:
        got = _summed(table, wide, (wide_k, wide_k + 1), moments) / fit.n
        fit.identity_error = float(np.abs(got[:, :-1] - np.outer(got[:, -1], got[:, -1]) - np.eye(wide_k)).max())
    return fit


def whiten(rows: DataFrame, fit: Whitening, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector: id, deviation (exact), whitened (one entry per component)."""
    table = _grid_table(rows, id_col, vector_col)
    wide = len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), wide)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fit.deviation(x), pa.decimal128(38, 0)), pa.array(fit.project(x).tolist(), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    schema = StructType([table.schema["id"], StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])
    return table.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def whitened_rows(rows: DataFrame, fit: Whitening, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component, with the figures of the fit."""
    shares = F.array(*[F.lit(e) for e in fit.explained]) if fit.explained else F.array().cast("array<double>")
    long = whiten(rows, fit, id_col=id_col, vector_col=vector_col).select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        id_col,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(fit.identity_error).alias("identity_error"),
    )
