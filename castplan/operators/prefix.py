"""Running sums that do not put a whole group in one task.

``Window.partitionBy(g).orderBy(o)`` sends every row of group ``g`` to one task; for a
group holding a large share of the data that task is the job.  ``running_sums`` instead
range-partitions by ``(g, o)`` into slices, sums inside each slice (bounded by the slice
size), and adds the totals of the earlier slices of the same group, taken from a tiny
per-(group, slice) table.  The order must be total (end it with a unique key) so that the
result is exact and deterministic.  Range bounds are sampled from the input and row order
after a shuffle is not fixed, so the sliced rows are written once to the run's folder
(``session.store``) and every consumer sees the same slices.  Without a number of slices, adaptive
execution cuts them by their measured size, up to ``spark.sql.shuffle.partitions``.  Rows whose group is
null are a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castplan.session import store


def running_sums(df: DataFrame, group_cols, order_cols, values: dict, slices: int | None = None, ties: int = 0) -> DataFrame:
    """Inclusive running sums of several value expressions (``{out_name: Column}``) in one
    slicing pass.  The last ``ties`` order columns only sort inside a slice: range bounds are found by
    sending samples of the columns that cut slices to the driver, which wide rows would fill."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    tmp = {f"_v_{k}": (v if isinstance(v, Column) else F.col(v)) for k, v in values.items()}
    ranged = df.withColumns(tmp).repartitionByRange(*([slices] if slices else []), *group_cols, *order_cols[:len(order_cols) - ties])
    r = store(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    w_local = (Window.partitionBy(*group_cols, "_slice").orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = r.withColumns({f"_l_{k}": F.sum(f"_v_{k}").over(w_local) for k in values})
    totals = r.groupBy(*group_cols, "_slice").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    w_off = Window.partitionBy(*group_cols).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (group, slice): bounded by groups x slices
    offs = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], F.col("_slice").alias("_gs"), *[F.coalesce(F.sum(f"_t_{k}").over(w_off), F.lit(0))
                                                  .alias(f"_o_{k}") for k in values])
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group_cols)] + [F.col("_slice") == F.col("_gs")]
    out = r.join(offs, same, "inner")
    out = out.withColumns({k: F.col(f"_o_{k}") + F.col(f"_l_{k}") for k in values})
    return out.drop("_slice", "_gs", *[f"_g{i}" for i in range(len(group_cols))], *[f"_{p}_{k}" for k in values for p in ("v", "l", "o")])


def running_sum(df: DataFrame, group_cols, order_cols, value: str, out: str,
                inclusive: bool = True, slices: int | None = None, ties: int = 0) -> DataFrame:
    """Running sum of one column; ``inclusive=False`` excludes the row itself."""
    r = running_sums(df, group_cols, order_cols, {out: F.col(value)}, slices, ties)
    return r if inclusive else r.withColumn(out, F.col(out) - F.col(value))
