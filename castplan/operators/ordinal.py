"""Gapless numbers of rows in the order of their source, without a sort of all rows in one task.

"The first non-blank customer of a job" and "names in the order in which they occur" need the order of
the input, which a distributed frame doesn't have.  ``file_ordinal`` numbers rows of files by file and
place, ``parquet_ordinal`` those of Parquet files without a copy; ``sorted_ordinal`` numbers rows by sort keys.
The number travels with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castplan.operators.prefix import running_sum
from castplan.session import store


def file_ordinal(df: DataFrame, out: str = "row_seq") -> DataFrame:
    """``df``, as read from files, with the number of every row from 1, by file name and place in the file.

    Rows of one split follow each other in a task, so a row's number is its place there plus the rows of all
    splits before; one row per split is summed up.  The rows are written once, so that the places and
    the sums are of the same splits.
    """
    rows = store(df.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
                                 "_at": F.monotonically_increasing_id()}), "numbered")
    splits = rows.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    shift = splits.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"),
                          (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return (rows.join(shift, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
            .withColumn(out, (F.col("_at") + F.col("_shift")).cast("long")).drop("_file", "_start", "_at", "_f", "_s", "_shift"))


def parquet_ordinal(df: DataFrame, out: str = "row_seq") -> DataFrame:
    """``df``, as read from Parquet files, with the number of every row from 1, by file name and place in the file.

    Parquet tells a row's place in its file, so a row's number is that plus the rows of all files before; one row per
    file is summed up.  Nothing is written or run before the rows are asked for; the files must not change until then.
    """
    files = df.groupBy(F.col("_metadata.file_path").alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    shift = files.select("_f", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).alias("_shift"))
    rows = df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    return (rows.join(F.broadcast(shift), F.col("_file") == F.col("_f"))
            .withColumn(out, (F.col("_at") + F.col("_shift")).cast("long")).drop("_file", "_at", "_f", "_shift"))


def sorted_ordinal(df: DataFrame, order, out: str = "row_seq") -> DataFrame:
    """``df`` with the number of every row from 1 by ``order`` (columns), then by all other columns; rows that are
    equal in all of them are numbered in any order.  Rows of equal ``order`` are numbered by one task."""
    keys = [c if not isinstance(c, str) else F.col(c).asc_nulls_last() for c in order]
    named = {c for c in order if isinstance(c, str)}
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in named]
    one = F.lit(0).alias("_all")
    return running_sum(df.select("*", one, F.lit(1).alias("_one")), ["_all"], [*keys, *rest], "_one", out, ties=len(rest)).drop("_all", "_one")


def names_in_order(df: DataFrame, keys: list, names: dict, order) -> DataFrame:
    """Per ``keys`` one text per entry of ``names`` (``{out: column}``): the distinct non-blank values, trimmed, by
    the first ``order`` (a struct column) at which each occurs, joined by commas.

    Values are reduced to one row each before any list is made.
    """
    out = None
    for name, column in names.items():
        value = F.nullif(F.trim(column), F.lit(""))
        first = (df.select(*keys, value.alias("_value"), order.alias("_order")).where("_value IS NOT NULL")
                 .groupBy(*keys, "_value").agg(F.min("_order").alias("_order")))
        listed = first.groupBy(*[F.col(k).alias(f"_k{i}_{name}") for i, k in enumerate(keys)]).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_order", "_value"))), lambda x: x["_value"]), ", ").alias(name))
        base = df.select(*keys).distinct() if out is None else out
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}_{name}")) for i, k in enumerate(keys)]
        on = same[0]
        for s in same[1:]:
            on = on & s
        out = base.join(listed, on, "left").drop(*[f"_k{i}_{name}" for i in range(len(keys))]).fillna("", [name])
    return out
