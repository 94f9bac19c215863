"""Sink-side orderings of the reports (``orderBy`` only where rows are written or shown).

Reports are unordered DataFrames everywhere else; sorting is the last step so it never
forces an early global sort into a plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def open_orders_order(df: DataFrame) -> DataFrame:
    """Open orders by due date, then job; dashboards by job."""
    return df.orderBy(F.col("due_date").asc_nulls_last(), F.col("job_number").asc_nulls_last())


def day_rows_order(df: DataFrame) -> DataFrame:
    """Rows of a day by alloy, due date, job (missing last); totals after the details."""
    keys = [c for c in ("pool", "schedule_day", "row_type") if c in df.columns]
    return df.orderBy(*keys, F.col("alloy").asc_nulls_last(), F.col("due_date").asc_nulls_last(),
                      F.col("job_number").asc_nulls_last())


def alloy_order(df: DataFrame, alloy_col: str, tie_breakers=(), blocks=()) -> DataFrame:
    """Alloy first with blank alloys last, then whichever tie-breakers the frame has; inside ``blocks``
    (pool and day columns) if any."""
    ties = [F.col(c).asc_nulls_last() for c in tie_breakers if c in df.columns]
    return df.orderBy(*blocks, F.nullif(F.trim(F.col(alloy_col)), F.lit("")).asc_nulls_last(), *ties)


def shipping_order(df: DataFrame) -> DataFrame:
    """Shipping outlook by status (alphabetical), due date, job."""
    return df.orderBy(F.col("schedule_status").asc_nulls_last(), F.col("due_date").asc_nulls_last(),
                      F.col("job_number").asc_nulls_last())
