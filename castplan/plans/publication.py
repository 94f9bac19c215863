"""The combined publication: named sheets of one schedule, each in its sheet order.

A sheet is written by ``orderBy``: range partitions, each sorted, so that the files by name hold the rows in
order and no task sorts a whole sheet.  ``read_sheets`` numbers the rows by their place in the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from castplan.operators.ordinal import parquet_ordinal
from castplan.plans import melt_reports, mold_reports, presentation, shipping
from castplan.plans.schedule import Schedule
from castplan.sources.history import write_reports


def six_sheets(schedule: Schedule, plan: DataFrame, summary: DataFrame) -> dict:
    """The sheets by name: overall status, melt schedule and diagnostics, mold schedule, melt and
    mold summaries."""
    p = schedule.params
    outlook = shipping.job_shipping_outlook(schedule.schedule_rows, schedule.assignments, p.start_date)
    return {
        "Overall Summary": presentation.shipping_order(shipping.job_status(outlook)),
        "Melt Schedule": presentation.alloy_order(melt_reports.melt_schedule(plan, p.start_date), "alloy",
                                                  ("job_number", "heat_number", "schedule_day"), ("pool", "pour_schedule_day")),
        "Melt Diagnostics": melt_reports.melt_gap_diagnostics(plan, p.start_date, p.limits).orderBy("pool", "skipped_pour_day"),
        "Mold Schedule": presentation.alloy_order(mold_reports.mold_schedule_sheet(schedule.assignments, p.start_date), "alloy",
                                                  ("job_number", "ext"), ("pool", "schedule_day", "row_type")),
        "Melt Summary": melt_reports.melt_management(summary, plan, p.start_date).orderBy("pool", "pour_schedule_day", "heat_number"),
        "Mold Summary": presentation.shipping_order(outlook),
    }


def day_sheets(schedule: Schedule) -> dict:
    """Open orders by due date and job, and the daily mold schedule by day, details before totals."""
    return {
        "Open Orders": presentation.open_orders_order(schedule.open_orders),
        "Daily Mold Schedule": presentation.day_rows_order(mold_reports.daily_mold_schedule(schedule.assignments, schedule.params.start_date)),
    }


def publish_sheets(sheets: dict, root: str, fmt: str = "parquet") -> dict:
    """Write the sheets, one directory each; returns the directory of every sheet."""
    return dict(zip(sheets, write_reports(sheets, root, fmt), strict=True))


def read_sheets(spark: SparkSession, paths: dict) -> dict:
    """The published sheets, with every row's ``position`` in its sheet; a sheet is read when it is asked for."""
    return {name: parquet_ordinal(spark.read.parquet(path), "position") for name, path in paths.items()}
