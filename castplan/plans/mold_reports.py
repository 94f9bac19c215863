"""Mold-side reports: daily schedule blocks with totals, sheet projection, capacity, day print.

Days are per capacity pool, so every report is keyed by ``pool`` and ``schedule_day``.  Day
numbers resolve to dates by the closed-form calendar (a projection, no join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castplan.functions.clean import blank_to_null
from castplan.functions.dates import weekday_name
from castplan.functions.status import capacity_label, risk_diagnostic, risk_status
from castplan.operators.calendar import day_date
from castplan.schemas import FLOOR_CAST_TYPE, CapacityLimits

DETAIL_COLUMNS = [
    "due_date", "customer_name", "part_number", "job_number", "ext", "alloy", "casting_type",
    "quantity_of_molds", "castings_per_mold", "quantity_of_cores", "heat_number",
    "pour_schedule_day", "mold_date", "mold_weekday", "pour_date", "pour_weekday",
    "pour_buffer_days", "due_buffer_status", "planner_diagnostic",
]


def daily_rows(assignments: DataFrame, start_date) -> DataFrame:
    """Assignment chunks with mold/pour dates, pour buffer and planner risk."""
    df = assignments.withColumns({
        "mold_date": day_date("schedule_day", start_date),
        "pour_date": day_date("pour_schedule_day", start_date),
    })
    df = df.withColumns({
        "mold_weekday": weekday_name("mold_date"),
        "pour_weekday": weekday_name("pour_date"),
        "pour_buffer_days": F.datediff(F.col("due_date"), F.col("pour_date")),
    })
    return df.withColumns({"due_buffer_status": risk_status("pour_buffer_days"),
                           "planner_diagnostic": risk_diagnostic("pour_buffer_days")})


def daily_mold_schedule(assignments: DataFrame, start_date) -> DataFrame:
    """Every chunk as a detail row, plus one totals row per (pool, day).

    ``row_type`` is ``detail`` or ``total``; totals carry the day's weight and mold sums and
    NULL in the detail columns.  Details aren't shuffled; only the narrow totals are.
    """
    keys, sums = ["pool", "schedule_day"], ["total_weight_per_ext", "molds_for_ext"]
    detail = mold_rows(assignments, start_date).withColumns({c: F.col(c).cast("long") for c in sums})
    total = assignments.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in sums])
    return (detail.withColumn("row_type", F.lit("detail"))
            .unionByName(total.withColumn("row_type", F.lit("total")), allowMissingColumns=True))


def mold_rows(assignments: DataFrame, start_date) -> DataFrame:
    """Flat mold rows: one per chunk, equal chunks kept apart."""
    return daily_rows(assignments, start_date).select("pool", "schedule_day", *DETAIL_COLUMNS, "total_weight_per_ext", "molds_for_ext")


def mold_schedule_sheet(assignments: DataFrame, start_date) -> DataFrame:
    """The mold schedule sheet: ten report columns per chunk, day totals, and per pool the
    average molds per scheduled day (``avg_molds_per_day``)."""
    d = daily_mold_schedule(assignments, start_date)
    sheet = d.select(
        "pool", "schedule_day", "row_type",
        day_date("schedule_day", start_date).alias("mold_date"),
        "customer_name", "part_number", "job_number", "ext", "alloy",
        F.col("casting_type").alias("mold_type"), "quantity_of_molds", "quantity_of_cores",
        F.col("total_weight_per_ext").alias("total_weight"),
        F.col("molds_for_ext").alias("molds_today"))
    avg = (assignments.groupBy("pool")
           .agg((F.sum("molds_for_ext") / F.greatest(F.count_distinct("schedule_day"), F.lit(1)))
                .alias("avg_molds_per_day")))
    return sheet.join(avg, "pool", "left")


def _lane_molds(assignments: DataFrame) -> DataFrame:
    ct = F.upper(F.trim(F.coalesce(F.col("casting_type"), F.lit(""))))
    m = F.greatest(F.round(F.coalesce(F.col("molds_for_ext"), F.lit(0))), F.lit(0))
    return assignments.withColumns({"_floor": F.when(ct == FLOOR_CAST_TYPE, m).otherwise(0),
                                    "_line": F.when(ct != FLOOR_CAST_TYPE, m).otherwise(0)})


def mold_capacity(assignments: DataFrame, limits: CapacityLimits = CapacityLimits()) -> DataFrame:
    """Line / floor molds per (pool, day) against the daily limits, as numbers and labels."""
    per_day = (_lane_molds(assignments).groupBy("pool", "schedule_day")
               .agg(F.sum("_line").cast("long").alias("line_molds"),
                    F.sum("_floor").cast("long").alias("floor_molds")))
    return per_day.select(
        "pool", "schedule_day", "line_molds", "floor_molds",
        F.concat(F.lit("Day "), F.col("schedule_day").cast("string")).alias("day_label"),
        capacity_label("L", F.col("line_molds"), limits.line_molds_per_day).alias("line_capacity"),
        capacity_label("F", F.col("floor_molds"), limits.floor_molds_per_day).alias("floor_capacity"),
        F.round(F.col("line_molds") / limits.line_molds_per_day, 4).alias("line_utilization"),
        F.round(F.col("floor_molds") / limits.floor_molds_per_day, 4).alias("floor_utilization"))


def day_summary(assignments: DataFrame) -> DataFrame:
    """Per (pool, day): distinct jobs, total molds, total row weight (half-even rounded)."""
    w = F.bround(F.coalesce(F.col("molds_for_ext"), F.lit(0))
                 * F.coalesce(F.col("pour_weight"), F.lit(0)), 0)
    return (assignments.groupBy("pool", "schedule_day")
            .agg(F.count_distinct(blank_to_null("job_number")).alias("unique_jobs"),
                 F.sum("molds_for_ext").cast("long").alias("total_molds"),
                 F.sum(w).cast("long").alias("total_row_weight")))


def report_averages(assignments: DataFrame) -> DataFrame:
    """Per pool: molds per scheduled day and poured pounds per pour day."""
    return assignments.groupBy("pool").agg(
        F.count_distinct("schedule_day").alias("mold_days"),
        F.sum("molds_for_ext").cast("long").alias("total_molds"),
        F.round(F.sum("molds_for_ext") / F.greatest(F.count_distinct("schedule_day"), F.lit(1)), 4)
        .alias("avg_molds_per_day"),
        F.count_distinct("pour_schedule_day").alias("pour_days"),
        F.sum("total_weight_per_ext").cast("long").alias("total_poured_lbs"),
        F.round(F.sum("total_weight_per_ext") / F.greatest(F.count_distinct("pour_schedule_day"), F.lit(1)), 4)
        .alias("avg_poured_lbs_per_day"))
