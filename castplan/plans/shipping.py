"""Job shipping outlook and overall job status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castplan.functions.clean import blank_to_null, norm_key_ws
from castplan.functions.status import (on_time_band, on_time_status, schedule_status,
                                       ship_buffer_band, status_band)
from castplan.operators.calendar import day_date
from castplan.schemas import CLEANING_DAYS


def job_shipping_outlook(schedule_rows: DataFrame, assignments: DataFrame, start_date,
                         cleaning_days: int = CLEANING_DAYS) -> DataFrame:
    """Per job: planned vs scheduled molds, first mold day, last pour day and their dates,
    expected ship date (pour + cleaning days), ship buffer, schedule status, on-time flag.

    Both sides are aggregated per job first, then joined (left from the planned side).  A job's customer
    is its first non-blank one by ``row_seq``; of rows without that number, by ``extension_seq`` and name.
    """
    seq = "row_seq" if "row_seq" in schedule_rows.columns else "struct(extension_seq, trim(customer_name))"
    key = norm_key_ws("job_number")
    planned = (schedule_rows.withColumn("_job", key)
               .groupBy("pool", "_job")
               .agg(F.sum("molds_for_ext").alias("planned_molds"),
                    F.min(F.col("due_date").cast("date")).alias("due_date"),
                    F.expr(f"min_by(trim(customer_name), {seq}) "
                           "FILTER (WHERE trim(customer_name) <> '')").alias("customer_name")))
    assigned = (assignments.withColumn("_job", key).groupBy("pool", "_job")
                .agg(F.sum("molds_for_ext").alias("scheduled_molds"),
                     F.min("schedule_day").alias("mold_day"),
                     F.max("pour_schedule_day").alias("pour_day")))
    j = planned.join(assigned, ["pool", "_job"], "left")
    j = j.withColumns({
        "scheduled_molds": F.coalesce(F.col("scheduled_molds"), F.lit(0)),
        "mold_date": day_date("mold_day", start_date),
        "pour_date": day_date("pour_day", start_date),
    })
    j = j.withColumn("expected_ship_date", F.date_add(F.col("pour_date"), cleaning_days))
    j = j.withColumn("ship_buffer_days", F.datediff(F.col("due_date"), F.col("expected_ship_date")))
    j = j.withColumn("schedule_status", schedule_status("planned_molds", "scheduled_molds"))
    j = j.withColumn("on_time", on_time_status("schedule_status", "ship_buffer_days"))
    return j.select(
        "pool", F.col("_job").alias("job_number"), "schedule_status",
        F.coalesce(blank_to_null("customer_name"), F.lit("")).alias("customer_name"),
        F.col("planned_molds").cast("long").alias("planned_molds"),
        F.col("scheduled_molds").cast("long").alias("scheduled_molds"),
        "mold_day", "mold_date", "pour_day", "pour_date", "expected_ship_date", "due_date",
        "ship_buffer_days", "on_time",
        status_band("schedule_status").alias("status_band"),
        on_time_band("on_time").alias("on_time_band"),
        ship_buffer_band("ship_buffer_days").alias("ship_buffer_band"))


def job_status(outlook: DataFrame) -> DataFrame:
    """Overall job status: the seven status columns of the outlook."""
    return outlook.select("pool", "job_number", "customer_name", "expected_ship_date", "due_date",
                          "ship_buffer_days", "on_time", "schedule_status", "on_time_band")
