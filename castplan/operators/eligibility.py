"""Scheduler input normalisation, eligibility with reject reasons, schedule-row expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castplan.functions.clean import (blank_to_null, ceil_int, molds_needed, row_weight,
                                      strip_headers, with_defaults)
from castplan.schemas import REJECT_CAST_TYPE, REJECT_JOB_TYPES

REASONS = ("blank", "hold", "job_type", "cast_type", "no_molds", "added")


def scheduler_input(open_orders: DataFrame, honor_hold: bool = True) -> DataFrame:
    """Open-order rows to scheduler input: remaining molds, hold and scheduled flags.

    ``molds_needed = max(quantity_of_molds - molds_completed, 0)`` on coerced numbers.  The
    ERP hold column (``on_hold``) becomes ``hold`` unless ``honor_hold`` is False, which
    reproduces a source where holds never reach the scheduler (hold = NO).
    Missing columns are back-filled with defaults.
    """
    df = strip_headers(open_orders)
    df = with_defaults(df, {"molds_completed": 0, "quantity_of_molds": 0, "scheduled": "NO",
                            "due_date": None, "job_number": "", "pour_weight": "",
                            "job_type": "", "alloy": "", "casting_type": "",
                            "customer_name": "", "part_number": "", "castings_per_mold": "",
                            "quantity_of_cores": ""})
    hold = (F.coalesce(F.col("on_hold"), F.lit("NO")) if (honor_hold and "on_hold" in df.columns)
            else (F.coalesce(F.col("hold"), F.lit("NO")) if "hold" in df.columns else F.lit("NO")))
    return df.withColumns({
        "molds_needed": molds_needed("quantity_of_molds", "molds_completed"),
        "hold": hold,
        "scheduled": F.coalesce(F.col("scheduled"), F.lit("NO")),
    })


def reject_reason(df: DataFrame) -> DataFrame:
    """Add ``reject_reason`` by the ordered rules; NULL means the row is eligible.

    blank job -> hold YES -> job type IFA/IFC -> cast type I -> molds needed <= 0 or missing.
    Flags are compared trimmed and upper-cased.
    """
    up = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    molds = F.col("molds_needed").cast("string").try_cast("double")
    return df.withColumn(
        "reject_reason",
        F.when(blank_to_null("job_number").isNull(), "blank")
        .when(up("hold") == "YES", "hold")
        .when(up("job_type").isin(*REJECT_JOB_TYPES), "job_type")
        .when(up("casting_type") == REJECT_CAST_TYPE, "cast_type")
        .when(molds.isNull() | (molds <= 0), "no_molds"))


def eligible(df: DataFrame) -> DataFrame:
    return reject_reason(df).where(F.col("reject_reason").isNull()).drop("reject_reason")


def reject_counts(df: DataFrame) -> DataFrame:
    """Rows per reason (``added`` = eligible), all six reasons always present.

    One aggregate pass with ``count_if`` per reason, then ``stack`` to rows.
    """
    r = reject_reason(df)
    reason = F.coalesce(F.col("reject_reason"), F.lit("added"))
    one = r.agg(*[F.count_if(reason == x).alias(x) for x in REASONS])
    stack = ", ".join(f"'{x}', `{x}`" for x in REASONS)
    return one.selectExpr(f"stack({len(REASONS)}, {stack}) AS (reason, job_count)")


def schedule_rows(eligible_rows: DataFrame) -> DataFrame:
    """One schedule row per eligible job: ceil'd molds, no extension, row weight.

    Rows whose ceil'd mold need is not positive are dropped.
    """
    m = ceil_int("molds_needed")
    eligible_rows = with_defaults(eligible_rows, {"pour_weight": 0})
    return (eligible_rows.withColumn("molds_for_ext", m).where(F.col("molds_for_ext") > 0)
            .withColumns({"ext": F.lit(""), "extension_seq": F.lit(0),
                          "total_weight_per_ext": row_weight(F.col("molds_for_ext"), F.col("pour_weight"))}))
