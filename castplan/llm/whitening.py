"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Every vector entry c becomes the integer floor(64 c) + 1,000,000.  One scan gives the count and the
exact sums, a second the centred scatter: each row is centred on the mean before it is multiplied, a
task adds its blocks up, and Spark adds the tasks' matrices row by row, so only one matrix of the
vectors' dimension reaches the driver.  There its pivoted Cholesky factor (P V P' = L L') is turned
by one-sided Jacobi rotations until its columns are orthogonal: L J = U S.  Squared column norms are
the eigenvalues of V, normalised columns its eigenvectors.  No product of the factor is formed, so
small eigenvalues keep their relative accuracy.  ``transform`` projects every row and divides by the
root of the eigenvalue.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries go, and so do
vectors of another length than the most frequent one (of equally frequent lengths the greatest
counts); repeated rows count as often as they occur; directions without variance have no component,
so a table of one distinct vector, like an empty one, gives no component; integers are clipped to
2^61 in magnitude; a squared deviation beyond a long is null.  Extra columns pass through; columns
that clash with the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castplan.llm import vectors as V
from castplan.llm.shared import without

SCALE, SHIFT = 64, 1_000_000
SWEEPS = 60


def integers(x: np.ndarray) -> np.ndarray:
    return V.floor_scaled(x, SCALE, SHIFT)


def pivoted_cholesky(a: np.ndarray):
    """``(L, order)`` with a[order][:, order] = L L', L lower trapezoidal; it ends at the numerical rank."""
    a = a.copy()
    d = len(a)
    order, out = np.arange(d), np.zeros((d, d))
    least = max(np.diag(a).max(initial=0.0), 0.0) * d * np.finfo(float).eps
    for k in range(d):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if not a[p, p] > least:
            return out[:, :k], order
        for m in (a, out):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        out[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        a[k + 1:, k + 1:] -= np.outer(out[k + 1:, k], out[k + 1:, k])
    return out, order


def jacobi_columns(factor: np.ndarray):
    """``(eigenvalues, eigenvectors)`` of factor factor', falling: rotates pairs of columns until all are
    orthogonal.  A round robin of disjoint pairs, all pairs of a round at once."""
    u = factor.copy()
    r = u.shape[1]
    small = np.finfo(float).eps * max(len(u), 8)  # a cosine that rounding can't tell from 0
    ring = list(range(r + r % 2))  # an odd count gets an idle place
    rounds = []
    for _ in range(max(len(ring) - 1, 0)):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:len(ring) // 2], ring[:len(ring) // 2 - 1:-1], strict=True) if max(a, b) < r]
        rounds.append(np.array(pairs, int).reshape(-1, 2).T)
        ring = [ring[0], ring[-1], *ring[1:-1]]
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds:
            x, y = u[:, p], u[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, off.max(initial=0.0))
            turn = off > small
            z = np.where(turn, (b - a) / np.where(turn, 2 * c, 1), 0.0)
            t = np.where(turn, np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z)), 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            u[:, p], u[:, q] = cos * (x - t * y), cos * (t * x + y)
        if worst <= small:
            break
    values = (u * u).sum(0)
    by = np.argsort(-values, kind="stable")
    return values[by], u[:, by] / np.sqrt(values[by])


class Whitening:
    """Count, exact sums, eigenvalues and unit components (rows) of the fitted vectors."""

    def __init__(self, n: int, sums: list, covariance: np.ndarray):
        self.n, self.sums, self.dim = n, [int(s) for s in sums], len(sums)
        factor, order = pivoted_cholesky(covariance)
        values, turned = jacobi_columns(factor)
        self.values = values
        self.components = np.zeros((len(values), self.dim))
        self.components[:, order] = turned.T
        trace = np.trace(covariance)
        self.explained = values / trace if len(values) else values

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean goes in integers, the rest in doubles."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def deviation(self, x: np.ndarray):
        """The sum over dimensions of (n x - S)^2, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        y = x - whole
        if y.size and (self.n * (int(np.abs(y).max()) + 1)) ** 2 * self.dim >= 1 << 62:
            y, rest = y.astype(object), rest.astype(object)
        y = self.n * y - rest
        return (y * y).sum(1)

    def whitened(self, x: np.ndarray, top: int) -> np.ndarray:
        k = min(top, len(self.values))
        return self.centred(x) @ (self.components[:k] / np.sqrt(self.values[:k, None])).T


def _moments(dim: int):
    def run(batches):
        n, total = 0, [0] * dim
        for batch in batches:
            x = integers(V.matrix(batch.column(0), dim))
            total = [a + b for a, b in zip(total, V.total(x), strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total], pa.list_(pa.decimal128(38, 0)))], names=["k", "v"])
    return run


def _scatter(dim: int, rows_of):
    """One row per matrix row and task: sums of the outer products of ``rows_of(vectors)``."""
    def run(batches):
        total = None
        for batch in batches:
            y = rows_of(V.matrix(batch.column(0), dim))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["k", "v"])
    return run


_EXACT = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", V.EXACT)])
_REAL = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])


def _square(parts: DataFrame, size: int) -> np.ndarray:
    rows = V.array_sums(parts, "k", "v")
    return np.array([rows[i] for i in range(size)]).reshape(size, size)


def fit(df: DataFrame, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of all finite vectors of ``df``; None if there are none."""
    rows, dim, n = V.fit_rows(df, vec_col)
    if not n:
        return None
    sums = V.exact_sums(rows.select("_x").mapInArrow(_moments(dim), _EXACT), "k", "v")[0]
    mean = Whitening(n, sums, np.zeros((dim, dim)))
    scatter = _square(rows.select("_x").mapInArrow(_scatter(dim, lambda x: mean.centred(integers(x))), _REAL), dim)
    return Whitening(n, sums, (scatter + scatter.T) / (2 * n))


ADDED = ["deviation", "whitened"]


def transform(df: DataFrame, model: Whitening, vec_col: str = "embedding", top: int = 32) -> DataFrame:
    """The rows whose vector was fit for the model, with ``deviation`` (long) and ``whitened``, one double per
    component of the first ``top``, by falling eigenvalue."""
    base = without(df, *ADDED)
    keep = base.columns
    rows = base.withColumn("_x", F.col(vec_col).cast("array<double>")).where(V.finite(F.col("_x")) & (F.size("_x") == model.dim))

    def run(batches):
        for batch in batches:
            x = integers(V.matrix(batch.column("_x"), model.dim))
            w = model.whitened(x, top)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], V.as_long(model.deviation(x)), flat], names=[*keep, *ADDED])

    added = [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    return rows.select(*keep, "_x").mapInArrow(run, T.StructType([*base.schema.fields, *added]))


def identity_error(df: DataFrame, model: Whitening, vec_col: str = "embedding", top: int = 32) -> float | None:
    """The largest absolute entry of the whitened rows' covariance (divisor n) minus the identity."""
    k = min(top, len(model.values))
    if not k:
        return None
    rows = df.select(F.col(vec_col).cast("array<double>").alias("_x")).where(V.finite(F.col("_x")) & (F.size("_x") == model.dim))
    ones = _square(rows.mapInArrow(_scatter(model.dim, lambda x: np.column_stack([model.whitened(integers(x), top), np.ones(len(x))])), _REAL), k + 1)
    mean = ones[k, :k] / model.n
    return float(np.abs(ones[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def report(df: DataFrame, vec_col: str = "embedding", top: int = 32) -> DataFrame:
    """One row per fitted row and component: the other columns of ``df``, ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    df = without(df, "component", "n", "deviation", "whitened", "explained", "identity_error")
    model = fit(df, vec_col)
    keep = [c for c in df.columns if c != vec_col]
    if model is None:
        model = Whitening(1, [0], np.zeros((1, 1)))
    error = identity_error(df, model, vec_col, top)
    out = transform(df, model, vec_col, top).select(*keep, "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    share = F.element_at(F.array(*[F.lit(float(v)) for v in model.explained[:top]] or [F.lit(0.0)]), F.col("_at") + 1)
    return out.select(*keep, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
