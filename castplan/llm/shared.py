"""Small helpers shared by the operators: run folders, sizes, row numbers, Arrow access."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from castplan.session import ensure_checkpoint_dir

_RUN_FOLDERS: list = []


def run_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one intermediate table under the session's ``spark.checkpoint.dir``."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}-{name}"
    _RUN_FOLDERS.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: later readers prune columns, a lost
    executor costs a re-read, and non-deterministic inputs are fixed."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``materialize`` with the folder's path, for ``discard``."""
    path = run_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def fixed_rows(df: DataFrame) -> DataFrame:
    """``df`` itself if every scan of it gives the same rows in the same order, else a written copy: the
    order in which an exchange's rows arrive isn't fixed."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialize(df, "fixed") if "Exchange" in plan or "ExistingRDD" in plan else df


def discard(spark: SparkSession, path: str) -> None:
    """Delete one run folder that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _RUN_FOLDERS.remove((spark, path))


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process (call when the results have been read)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for owner, path in [x for x in _RUN_FOLDERS if x[0] is spark]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _RUN_FOLDERS.remove((owner, path))


@atexit.register
def _cleanup_at_exit() -> None:
    for spark in {id(s): s for s, _ in _RUN_FOLDERS}.values():
        try:
            cleanup(spark)
        except Exception:  # noqa: BLE001  the session is already gone; its folder is the cluster's to clear
            pass


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns (any case) that an operator is about to add under the same name."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def join_unique(left: DataFrame, right: DataFrame, on: list, how: str = "left", share: int = 1000) -> DataFrame:
    """Join ``left`` (inner or left) to ``right``, which has one row per value of ``on``, whatever the skew of ``left``.

    Values that hold more than 1/``share`` of the rows are fewer than ``share``; their rows of ``right`` are
    broadcast.  The other rows are shuffled, none of which has a hot value.  A null value matches
    nothing and isn't shuffled.
    """
    present = F.lit(True)
    for c in on:
        present = present & F.col(c).isNotNull()
    known = left.where(present)
    counts = known.groupBy(*on).agg(F.count(F.lit(1)).alias("_count"))
    total = known.count()
    hot = materialize(counts.where(F.col("_count") * share > total).select(*on, F.lit(True).alias("_hot")), "hot")
    marked = known.join(F.broadcast(hot), on, "left")
    some = right.join(F.broadcast(hot.drop("_hot")), on, "left_semi")
    out = marked.where("_hot").drop("_hot").join(F.broadcast(some), on, how)
    out = out.unionByName(marked.where("_hot IS NULL").drop("_hot").join(right, on, how))
    return out if how == "inner" else out.unionByName(left.where(~present), allowMissingColumns=True)


def slices_for(rows: int, per_slice: int = 100_000) -> int:
    return max(1, -(-rows // per_slice))


def gapless(df: DataFrame, group: list[str], order: list[Column], out: str, rows: int, by: Column) -> DataFrame:
    """Number rows 0, 1, ... inside each group without putting a group in one task.

    A group is cut into slices by ``by`` (a hash of the row), rows are numbered inside a slice,
    and the counts of the earlier slices (one row per group and slice) are added.
    """
    n = slices_for(rows)
    df = df.withColumn("_slice", F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
    counts = df.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_gs"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order)) - 1
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_slice") == F.col("_gs")]
    return (df.withColumn("_inside", inside).join(counts, on, "inner")
            .withColumn(out, (F.col("_before") + F.col("_inside")).cast("long"))
            .drop("_slice", "_gs", "_before", "_inside", *[f"_g{i}" for i in range(len(group))]))


def text_chunks(column: pa.Array, max_bytes: int = 1 << 18):
    """Split one Arrow string column into runs of whole texts of about ``max_bytes``.

    Yields ``(first_row, end_row, bytes as uint8, offsets)``; nulls are empty texts.  A text
    longer than ``max_bytes`` makes a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi
