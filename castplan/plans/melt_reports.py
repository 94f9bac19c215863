"""Melt-side reports: management summary, melt capacity, melt schedule, gap diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castplan.functions.clean import heat_key
from castplan.functions.dates import date_range_text, weekday_name
from castplan.functions.status import capacity_label
from castplan.operators.calendar import day_date
from castplan.operators.heats import plan_order
from castplan.operators.ordinal import names_in_order
from castplan.plans.heat_reports import HEAT_KEY
from castplan.schemas import CLEANING_DAYS, FLOOR_CAST_TYPE, MOLD_LEAD_WINDOW_DAYS, CapacityLimits

# Likely-cause texts of the gap diagnostics, in rule order.
CAUSE_NO_HEATS = "No heats remained targeted to this day after sequencing and prioritization."
CAUSE_NOT_PUSHED = "No final pours landed on this day after melt-plan rebuild."
CAUSE_NO_CAPACITY = ("Original heats were pushed later because no pre-pour line or floor mold "
                     "capacity remained in the 5-day window.")
CAUSE_LINE_FULL = ("Original heats were pushed later because line mold capacity was fully consumed "
                   "in the 5-day window.")
CAUSE_FLOOR_FULL = ("Original heats were pushed later because floor mold capacity was fully consumed "
                    "in the 5-day window.")
CAUSE_SEQUENCE = ("Original heats were pushed later to keep heat sequence and mold constraints "
                  "feasible.")


def melt_management(summary: DataFrame, plan: DataFrame, start_date,
                    cleaning_days: int = CLEANING_DAYS) -> DataFrame:
    """Per heat (Reserved excluded): customers and jobs poured in the order of the plan's rows, due/mold/pour date ranges,
    expected ship date and the heat's risk and two-week status."""
    per_heat = (plan.withColumn("_mold_date", day_date("schedule_day", start_date))
                .groupBy(*HEAT_KEY).agg(F.min("_mold_date").alias("_m0"), F.max("_mold_date").alias("_m1")))
    names = names_in_order(plan, HEAT_KEY, {"customers": "customer_name", "poured_job_ids": "job_number"}, plan_order(plan))
    s = summary.where(F.coalesce(F.col("heat_status"), F.lit("")) != "Reserved")
    j = s.join(per_heat, HEAT_KEY, "left").join(names, HEAT_KEY, "left")
    return j.select(
        *HEAT_KEY, F.col("schedule_date").alias("pour_date"), "customers", "poured_job_ids",
        date_range_text(F.least("earliest_due_date", "latest_due_date"),
                        F.greatest("earliest_due_date", "latest_due_date")).alias("due_dates"),
        date_range_text("_m0", "_m1").alias("mold_dates"),
        date_range_text("schedule_date", "schedule_date").alias("pour_dates"),
        F.date_add("schedule_date", cleaning_days).alias("expected_ship_date"),
        "pour_buffer_days", "due_buffer_status", "two_week_rule_status", "planner_diagnostic")


def melt_capacity(plan: DataFrame, limits: CapacityLimits = CapacityLimits()) -> DataFrame:
    """Per (pool, pour day): distinct non-blank heats and rounded weight vs the melt targets."""
    hk = heat_key("heat_number")
    per_day = plan.groupBy("pool", "pour_schedule_day").agg(
        F.count_distinct(F.when(hk != "", hk)).alias("heat_count"),
        F.round(F.sum(F.coalesce(F.col("total_weight_per_ext"), F.lit(0)))).cast("long").alias("total_weight"))
    return per_day.select(
        "pool", "pour_schedule_day", "heat_count", "total_weight",
        F.concat(F.lit("Day "), F.col("pour_schedule_day").cast("string")).alias("day_label"),
        capacity_label("Heats", F.col("heat_count"), limits.melt_heats_per_day).alias("heat_capacity"),
        capacity_label("Lbs", F.col("total_weight"), limits.melt_lbs_per_day).alias("weight_capacity"))


def melt_schedule(plan: DataFrame, start_date, display_offset_days: int = 1) -> DataFrame:
    """Melt department rows per pour day with molds on floor.

    Rows are ordered by alloy (blank last), job, ext, heat, mold day; *molds on floor* is the
    molds of earlier rows in the same consecutive run of one heat (gaps and islands: a new
    run starts whenever the heat changes).  The display date is the pour day's date plus
    ``display_offset_days``; the weekday is the pour day's own.
    """
    alloy_sort = F.nullif(F.trim(F.col("alloy")), F.lit(""))
    order = [alloy_sort.asc_nulls_last(), F.col("job_number").asc_nulls_last(),
             F.col("ext").asc_nulls_last(), heat_key("heat_number").asc_nulls_last(),
             F.col("schedule_day").asc_nulls_last()]
    w = Window.partitionBy("pool", "pour_schedule_day").orderBy(*order)
    df = plan.withColumn("_hk", heat_key("heat_number"))
    df = df.withColumn("_new", F.when(F.lag("_hk").over(w) == F.col("_hk"), 0).otherwise(1))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    w_run = (Window.partitionBy("pool", "pour_schedule_day", "_run").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, -1))
    m = F.greatest(F.round(F.coalesce(F.col("molds_for_ext"), F.lit(0))), F.lit(0))
    df = df.withColumn("molds_on_floor", F.coalesce(F.sum(m).over(w_run), F.lit(0)).cast("long"))
    pd_ = day_date("pour_schedule_day", start_date)
    return df.select(
        "pool", "pour_schedule_day", "schedule_day",
        F.date_add(pd_, display_offset_days).alias("pour_date"), weekday_name(pd_).alias("weekday"),
        "heat_number", F.trim("alloy").alias("alloy"), F.trim("job_number").alias("job_number"),
        "molds_on_floor", F.coalesce(F.col("total_weight_per_ext"), F.lit(0)).cast("double")
        .alias("pour_weight_required_lbs"), F.trim("part_number").alias("part_number"))


def melt_gap_diagnostics(plan: DataFrame, start_date, limits: CapacityLimits = CapacityLimits(),
                         window_days: int = MOLD_LEAD_WINDOW_DAYS) -> DataFrame:
    """Skipped pour days between a pool's first and last pour day, with the mold capacity
    used in the ``window_days`` mold days before each, heat moves, and a likely cause.

    The range join "mold days in the window before a missing day" is turned into an equi
    join by exploding each missing day into its (at most ``window_days``) window days.
    """
    pour_days = plan.select("pool", "pour_schedule_day").distinct()
    # skipped days are the gaps between consecutive pour days; each gap is exploded on its own
    w = Window.partitionBy("pool").orderBy("pour_schedule_day")
    gaps = (pour_days.withColumn("_prev", F.lag("pour_schedule_day").over(w))
            .where(F.col("pour_schedule_day") - F.col("_prev") > 1))
    missing = gaps.select("pool", F.explode(F.sequence(F.col("_prev") + 1, F.col("pour_schedule_day") - 1))
                          .alias("day"))
    ct = F.upper(F.trim(F.coalesce(F.col("casting_type"), F.lit(""))))
    m = F.greatest(F.round(F.coalesce(F.col("molds_for_ext"), F.lit(0))), F.lit(0))
    usage = plan.groupBy("pool", F.col("schedule_day").alias("wday")).agg(
        F.sum(F.when(ct == FLOOR_CAST_TYPE, m).otherwise(0)).alias("floor_used_d"),
        F.sum(F.when(ct != FLOOR_CAST_TYPE, m).otherwise(0)).alias("line_used_d"))
    win = missing.withColumn("_ws", F.greatest(F.lit(1), F.col("day") - window_days))
    win_days = win.select("pool", "day", "_ws",
                          F.explode(F.sequence("_ws", F.col("day") - 1)).alias("wday")) \
        .where(F.col("wday") < F.col("day"))
    used = (win_days.join(usage, ["pool", "wday"], "left")
            .groupBy("pool", "day").agg(F.sum(F.coalesce("line_used_d", F.lit(0))).alias("line_used"),
                                        F.sum(F.coalesce("floor_used_d", F.lit(0))).alias("floor_used")))
    moves = plan.select("pool", "original_pour_schedule_day", "pour_schedule_day", "heat_number") \
        .where(F.col("heat_number").isNotNull()).distinct()
    mv = moves.groupBy("pool", F.col("original_pour_schedule_day").alias("day")).agg(
        F.count(F.lit(1)).alias("original_heats_on_day"),
        F.count_if(F.col("pour_schedule_day") > F.col("original_pour_schedule_day")).alias("heats_pushed_later"),
        F.array_join(F.array_sort(F.collect_set(F.when(
            F.col("pour_schedule_day") > F.col("original_pour_schedule_day"), F.col("pour_schedule_day")))), ", ")
        .alias("pushed_to_pour_days"))
    j = win.join(used, ["pool", "day"], "left").join(mv, ["pool", "day"], "left")
    n_win = F.col("day") - F.col("_ws")
    line_cap = n_win * limits.line_molds_per_day
    floor_cap = n_win * limits.floor_molds_per_day
    line_used = F.coalesce(F.col("line_used"), F.lit(0)).cast("long")
    floor_used = F.coalesce(F.col("floor_used"), F.lit(0)).cast("long")
    j = j.withColumns({"_orig": F.coalesce("original_heats_on_day", F.lit(0)),
                       "_push": F.coalesce("heats_pushed_later", F.lit(0)),
                       "_lfree": F.greatest(line_cap - line_used, F.lit(0)),
                       "_ffree": F.greatest(floor_cap - floor_used, F.lit(0))})
    cause = (F.when(F.col("_orig") <= 0, CAUSE_NO_HEATS).when(F.col("_push") <= 0, CAUSE_NOT_PUSHED)
             .when((F.col("_lfree") <= 0) & (F.col("_ffree") <= 0), CAUSE_NO_CAPACITY)
             .when(F.col("_lfree") <= 0, CAUSE_LINE_FULL).when(F.col("_ffree") <= 0, CAUSE_FLOOR_FULL)
             .otherwise(CAUSE_SEQUENCE))
    d = day_date("day", start_date)
    return j.select(
        "pool", F.col("day").alias("skipped_pour_day"), d.alias("skipped_pour_date"),
        weekday_name(d).alias("weekday"), F.col("_orig").alias("original_heats_on_day"),
        F.col("_push").alias("heats_pushed_later"),
        F.coalesce("pushed_to_pour_days", F.lit("")).alias("pushed_to_pour_days"),
        F.when(n_win > 0, F.concat_ws("-", F.col("_ws").cast("string"), (F.col("day") - 1).cast("string")))
        .otherwise(F.lit("")).alias("mold_window_days"),
        F.format_string("%d/%d", line_used, line_cap.cast("long")).alias("window_line_usage"),
        F.format_string("%d/%d", floor_used, floor_cap.cast("long")).alias("window_floor_usage"),
        cause.alias("likely_cause"))
