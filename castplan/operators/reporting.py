"""Open-order report publishing helpers: canonical text rendering and the Scheduled flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castplan.functions.clean import canonical_number_text, norm_key_ws, plain_text
from castplan.schemas import HEADER_TO_COLUMN, NUMERIC_OPEN_ORDER_COLUMNS, OPEN_ORDER_COLUMNS


def scheduled_flag(orders: DataFrame, assignments: DataFrame, job_col: str = "job_number") -> DataFrame:
    """``scheduled`` = YES when the job appears in the mold schedule, else NO.

    The schedule side is reduced to its distinct job keys before the left join.
    """
    jobs = assignments.select(norm_key_ws(job_col).alias("_sj")).distinct()
    j = orders.join(jobs, norm_key_ws(job_col) == F.col("_sj"), "left")
    return j.withColumn("scheduled", F.when(F.col("_sj").isNotNull(), "YES").otherwise("NO")).drop("_sj")


def open_order_report(orders: DataFrame, assignments: DataFrame) -> DataFrame:
    """The open-order report as text: numbers in canonical form (blank when not numeric,
    molds completed blank -> 0), other values as plain text, plus the Scheduled flag."""
    flagged = scheduled_flag(orders, assignments)
    cols = []
    for c in OPEN_ORDER_COLUMNS:
        if c == "on_hold":
            continue
        if c == "molds_completed":
            v = F.coalesce(canonical_number_text(F.coalesce(F.col(c).cast("string"), F.lit("0"))), F.lit(""))
        elif c in NUMERIC_OPEN_ORDER_COLUMNS:
            v = F.coalesce(canonical_number_text(c), F.lit(""))
        else:
            v = plain_text(c, is_date=(c == "due_date"))
        cols.append(v.alias(c))
    return flagged.select(F.col("pool"), F.col("scheduled"), *cols)


def report_sheet(scheduler_input: DataFrame) -> DataFrame:
    """The scheduler's input as a report sheet: every column as text under its report header,
    with Molds Needed, Hold, Scheduled and the capacity pool."""
    return scheduler_input.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h)
                                    for h, c in HEADER_TO_COLUMN.items() if c in scheduler_input.columns])
