"""Helpers of the vector operators: which rows count, Arrow lists as matrices, exact sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(vector: Column) -> Column:
    """True for vectors that aren't null or empty and hold neither nulls nor non-finite numbers."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def fit_rows(df: DataFrame, vec_col: str) -> tuple[DataFrame, int, int]:
    """``(rows, dimension, count)``: ``df`` with ``_x``, the vector as doubles, for the finite vectors
    of the most frequent length (of equally frequent lengths the greatest); other rows go."""
    df = df.withColumn("_x", F.col(vec_col).cast("array<double>")).where(finite(F.col("_x")))
    top = df.groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim, n = (top.d, top.n) if top else (0, 0)
    return df.where(F.size("_x") == dim), dim, n


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column of equal lengths as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


#: Integers are clipped to this magnitude, so that they and their differences are longs.
LIMIT = 1 << 61


def floor_scaled(x: np.ndarray, scale: int, shift: int = 0) -> np.ndarray:
    """floor(scale * x) + shift as longs, clipped to ``LIMIT``; exact, as ``scale`` is a power of two."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -LIMIT, LIMIT).astype(np.int64) + shift


def total(x: np.ndarray) -> list:
    """Exact column sums of a matrix of longs."""
    small = not x.size or max(int(x.max()), -int(x.min())) * len(x) < 1 << 62
    return [int(s) for s in (x if small else x.astype(object)).sum(0)]


def as_long(values) -> pa.Array:
    """Integers as an Arrow long column; what a long can't hold is null."""
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values.astype(np.int64))
    return pa.array([v if -(1 << 63) <= v < 1 << 63 else None for v in map(int, values)], pa.int64())


EXACT = T.ArrayType(T.DecimalType(38, 0))


def exact_sums(parts: DataFrame, key: str, values: str) -> dict:
    """``{key: sums}``: arrays of whole numbers added up by place, in decimals.  ``parts`` has a few rows
    per task; one row per key and place reaches the driver, so both must be bounded by a model's size."""
    rows = (parts.select(key, F.posexplode(values).alias("_place", "_value")).groupBy(key, "_place")
            .agg(F.sum("_value").alias("_sum")).collect())
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r[key], r["_place"])):
        out.setdefault(r[key], []).append(int(r["_sum"]))
    return out


def array_sums(parts: DataFrame, key: str, values: str) -> dict:
    """``{key: sums}`` of arrays of doubles.  The rows of a key meet in one task, which keeps a running
    sum, not the rows; one array per key reaches the driver, bounded by a model's size."""
    def add(batches):
        total: dict = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                                         names=[key, values])

    own = parts.select(F.col(key).cast("long").alias(key), values).repartition(key)
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(values, T.ArrayType(T.DoubleType()))])
    return {r[0]: np.array(r[1]) for r in own.mapInArrow(add, schema).collect()}
