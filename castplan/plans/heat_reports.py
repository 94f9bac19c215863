"""Heat-level reports over a melt plan: summary, planner, daily totals, detail, heat sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castplan.functions.dates import target_pour_date, weekday_name
from castplan.functions.status import (breakout_text, due_buffer_band, risk_diagnostic, risk_status,
                                       two_week_band, two_week_note, two_week_status)
from castplan.operators.calendar import day_date
from castplan.operators.heats import heat_summary, plan_order, reserved_slots

HEAT_KEY = ["pool", "pour_schedule_day", "heat_number"]


def heat_summary_rows(plan: DataFrame, start_date, reference_date, reserved: tuple = ()) -> DataFrame:
    """The 25-column heat summary plus keys.  Heat-level enrichments (lead days, minimum
    days until due, job breakout in the order of the plan's rows) are aggregated once per heat and joined on
    the heat key.  ``reserved`` slots of every pour day are rows without a heat, blank but for the slot."""
    hs = heat_summary(plan, reference_date)
    enrich = plan.groupBy(*HEAT_KEY).agg(
        F.max(F.col("pour_schedule_day") - F.col("schedule_day")).alias("max_mold_lead_days"),
        F.round(F.avg((F.col("pour_schedule_day") - F.col("schedule_day")).cast("decimal(10,0)")), 1)
        .cast("double").alias("avg_mold_lead_days"),
        F.min("days_until_due").alias("_min_until_due"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(plan_order(plan).alias("at"), breakout_text(
            "job_number", "ext", "due_date", "molds_for_ext").alias("text")))), lambda x: x["text"]), "; ").alias("job_breakout"))
    j = hs.join(enrich, HEAT_KEY, "left")
    j = j.withColumn("schedule_date", day_date("pour_schedule_day", start_date))
    j = j.withColumn("pour_buffer_days", F.datediff(F.col("earliest_due_date"), F.col("schedule_date")))
    rows = j.select(
        *HEAT_KEY, "schedule_date", weekday_name("schedule_date").alias("weekday"), "heat_slot",
        "global_heat_number", "heat_status", "planning_priority", "review_window", "anchor_alloy",
        "compatibility_group", "earliest_due_date", "latest_due_date",
        target_pour_date("earliest_due_date").alias("target_pour_date"), "pour_buffer_days",
        risk_status("pour_buffer_days").alias("due_buffer_status"), "total_weight_lbs", "total_molds",
        "rows_in_heat", "jobs", "extensions", "max_mold_lead_days", "avg_mold_lead_days",
        two_week_status("pour_buffer_days", "_min_until_due").alias("two_week_rule_status"),
        two_week_note("pour_buffer_days", "_min_until_due").alias("two_week_rule_note"),
        "job_breakout", risk_diagnostic("pour_buffer_days").alias("planner_diagnostic"))
    if not reserved:
        return rows
    slots = reserved_slots(plan, reserved).withColumn("schedule_date", day_date("pour_schedule_day", start_date))
    slots = slots.withColumns({"weekday": weekday_name("schedule_date"), "total_weight_lbs": F.lit(0.0), "total_molds": F.lit(0.0), "rows_in_heat": F.lit(0),
                               **{c: F.lit("") for c, t in rows.dtypes if t == "string" and c not in ("weekday", "heat_status")}})
    return rows.unionByName(slots.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in slots.columns]), allowMissingColumns=True)


def heat_planner_rows(summary: DataFrame) -> DataFrame:
    """Planner sheet: summary without rows/breakout, plus four blank manual-entry columns."""
    return summary.drop("rows_in_heat", "job_breakout").withColumns({
        "manual_alloy": F.lit(None).cast("string"), "manual_weight_lbs": F.lit(None).cast("double"),
        "manual_molds": F.lit(None).cast("double"), "planner_notes": F.lit(None).cast("string"),
        "two_week_band": two_week_band("two_week_rule_status"),
        "due_buffer_band": due_buffer_band("due_buffer_status")})


def heat_daily_totals(summary: DataFrame) -> DataFrame:
    """Per (pool, date): distinct heats, planned / overflow / at-risk counts, weight, molds.
    Reserved slots are excluded."""
    s = summary.where(F.coalesce(F.col("heat_status"), F.lit("")) != "Reserved")
    return s.groupBy("pool", "schedule_date", "weekday").agg(
        F.count_distinct("heat_number").alias("total_heats"),
        F.count_if(F.col("heat_status") == "Planned").alias("planned_heats"),
        F.count_if(F.col("heat_status") == "Overflow").alias("overflow_heats"),
        F.sum("total_weight_lbs").alias("total_weight_lbs"),
        F.sum("total_molds").alias("total_molds"),
        F.count_if(F.col("due_buffer_status") == "AT RISK").alias("at_risk_heats"))


def heat_detail_rows(plan: DataFrame, start_date) -> DataFrame:
    """Row-level heat plan: one row per chunk with its heat, priority and due buffer."""
    d = plan.withColumn("schedule_date", day_date("pour_schedule_day", start_date))
    return d.select(
        "pool", "schedule_date", weekday_name("schedule_date").alias("weekday"), "pour_schedule_day",
        "heat_number", "global_heat_number", "planning_priority", "review_window", "days_until_due",
        "due_date", F.datediff(F.col("due_date"), F.col("schedule_date")).alias("due_buffer_days"),
        "compatibility_group", "alloy", "job_number", "ext", "extension_seq", "molds_for_ext",
        F.col("total_weight_per_ext").cast("double").alias("total_weight_per_ext"))


def heat_sheet(summary: DataFrame) -> DataFrame:
    """Heat schedule sheet: summary rows as they are plus a totals row per (pool, date), and per
    pool the average poured pounds per day (Reserved excluded)."""
    cols = ["heat_slot", "heat_number", "heat_status", "anchor_alloy", "compatibility_group",
            "earliest_due_date", "due_buffer_status", "two_week_rule_status"]
    keys = ["pool", "schedule_date", "weekday"]
    sums = ["total_weight_lbs", "total_molds"]
    total = summary.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("row_type", F.lit("total"))
    detail = summary.select(*keys, *cols, *[F.col(c).cast(total.schema[c].dataType).alias(c) for c in sums], F.lit("detail").alias("row_type"))
    g = detail.unionByName(total, allowMissingColumns=True)
    live = summary.where(F.coalesce(F.col("heat_status"), F.lit("")) != "Reserved")
    avg = live.groupBy("pool").agg(
        (F.sum("total_weight_lbs") / F.greatest(F.count_distinct("schedule_date"), F.lit(1)))
        .alias("avg_poured_lbs_per_day"))
    return g.join(avg, "pool", "left")
