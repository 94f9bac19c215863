"""Due-date planning priority (classification and ranking)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castplan.operators.prefix import running_sum
from castplan.functions.dates import (days_until, priority_label, priority_rank, review_window,
                                      to_date_or_null)


def prioritize(rows: DataFrame, reference_date, partition_cols=("pool",)) -> DataFrame:
    """Annotate rows with priority rank / label / review window / days until due and rank
    them (``planning_seq``) by (rank, due nulls last, job, extension seq) inside each
    partition (capacity pool); the order must be total (job + extension unique per pool).  Compatibility group defaults to the alloy, accept-all to NO.
    """
    due = to_date_or_null(F.col("due_date"))
    df = rows.withColumn("due_date_sort", due)
    df = df.withColumns({
        "planning_priority_rank": priority_rank(F.col("due_date_sort"), reference_date),
        "days_until_due": days_until(F.col("due_date_sort"), reference_date),
    })
    df = df.withColumns({
        "planning_priority": priority_label(F.col("planning_priority_rank")),
        "review_window": review_window(F.col("planning_priority_rank")),
    })
    if "compatibility_group" not in df.columns:
        alloy = F.col("alloy") if "alloy" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("compatibility_group", F.coalesce(alloy, F.lit("")))
    if "compat_all" not in df.columns:
        df = df.withColumn("compat_all", F.lit("NO"))
    if "extension_seq" not in df.columns:
        df = df.withColumn("extension_seq", F.lit(0))
    parts = [c for c in partition_cols if c in df.columns]
    order = [F.col("planning_priority_rank").asc_nulls_last(), F.col("due_date_sort").asc_nulls_last(),
             F.col("job_number").asc_nulls_last(), F.col("extension_seq").asc_nulls_last()]
    # row number = running count over range slices, so a large pool is not one window task
    ranked = running_sum(df.withColumn("_one", F.lit(1)), parts, order, "_one", "planning_seq")
    return ranked.withColumn("planning_seq", F.col("planning_seq").cast("int")).drop("_one")
