"""Melt plan: pour days and heat numbers for assignment chunks.

The planning rules being reproduced define how heat-level reports read a melt plan but ship
no producer for it (every chunk pours on its mold day in heat 1).  This module is our
documented producer, kept deliberately simple and deterministic:

* the furnace pours every ``furnace_every_n_days``-th working day: a chunk molded on day
  ``d`` pours on ``ceil(d / n) * n`` (``original_pour_schedule_day`` keeps ``d``);
* inside one (pool, pour day, compatibility group), chunks are packed in (alloy, job, ext,
  mold day) order, and a new heat starts each time the weight before a chunk passes another
  ``heat_weight_mark`` pounds.  The mark cuts, it does not limit: a chunk is never split, so a
  heat weighs up to the mark plus its last chunk;
* heats of a pour day are numbered by (group, heat within group); the first
  ``planned_heats_per_day`` are ``Planned``, the rest ``Overflow``;
* slots in ``reserved`` are set aside on every pour day, for heats that are planned by hand; heats take
  the other slots in order (``reserved_slots`` gives the rows of the summary);
* ``global_heat_number`` counts heats through the pool's earlier pour days.

A (pool, pour day) holds at most ``n`` days of capacity-limited work, so every window here
runs over a small bounded group; the one pool-wide window runs over per-day counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castplan.functions.dates import days_until, priority_label, priority_rank, review_window
from castplan.operators.prefix import running_sum
from castplan.schemas import MAX_PLANNED_HEATS_PER_DAY

HEAT_WEIGHT_MARK_LBS = 2300
FURNACE_EVERY_N_DAYS = 2


def plan_order(plan: DataFrame):
    """The order of a plan's rows: mold day, then the row's priority in its pool; of plans without
    priorities alloy, job, extension (missing last) and mold day."""
    if "priority_seq" in plan.columns:
        return F.struct("schedule_day", "priority_seq")
    keys = [k for c in ("alloy", "job_number", "ext", "schedule_day") for k in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    return F.struct(*keys)


def slot_of(heat_number, reserved: tuple):
    """The slot of a day's n-th heat when some slots are reserved: heats are numbered around them."""
    slot = F.col(heat_number) if isinstance(heat_number, str) else heat_number
    for r in sorted(set(reserved)):
        slot = F.when(slot >= r, slot + 1).otherwise(slot)
    return slot


def reserved_slots(plan: DataFrame, reserved: tuple) -> DataFrame:
    """One row per pour day and reserved slot, without a heat."""
    days = plan.select("pool", "pour_schedule_day").distinct()
    return days.withColumn("heat_slot", F.explode(F.array(*[F.lit(int(r)) for r in sorted(set(reserved))]))).withColumns({
        "heat_number": F.lit(None).cast("int"), "heat_status": F.lit("Reserved")})


def heat_order():
    return [F.col("alloy").asc_nulls_last(), F.col("job_number").asc_nulls_last(),
            F.col("ext").asc_nulls_last(), F.col("schedule_day").asc_nulls_last()]


def melt_plan(assignments: DataFrame, reference_date, furnace_every_n_days: int = FURNACE_EVERY_N_DAYS,
              heat_weight_mark: float = HEAT_WEIGHT_MARK_LBS,
              planned_heats_per_day: int = MAX_PLANNED_HEATS_PER_DAY, reserved: tuple = ()) -> DataFrame:
    n = int(furnace_every_n_days)
    df = assignments.withColumns({
        "original_pour_schedule_day": F.col("schedule_day"),
        "pour_schedule_day": (F.ceil(F.col("schedule_day") / n) * n).cast("int"),
        "days_until_due": days_until(F.col("due_date"), reference_date),
        "planning_priority_rank": priority_rank(F.col("due_date"), reference_date),
    }).withColumns({
        "planning_priority": priority_label("planning_priority_rank"),
        "review_window": review_window("planning_priority_rank"),
    })
    # one shuffle by (pool, pour day) serves both windows below
    df = df.repartition("pool", "pour_schedule_day")
    w_run = (Window.partitionBy("pool", "pour_schedule_day", "compatibility_group").orderBy(*heat_order())
             .rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_before", F.coalesce(F.sum("total_weight_per_ext").over(w_run), F.lit(0)))
    df = df.withColumn("_gheat", F.floor(F.col("_before") / F.lit(heat_weight_mark)))
    w_heat = Window.partitionBy("pool", "pour_schedule_day").orderBy(
        F.col("compatibility_group").asc_nulls_last(), F.col("_gheat"))
    df = df.withColumn("heat_number", F.dense_rank().over(w_heat).cast("int"))
    per_day = df.groupBy("pool", "pour_schedule_day").agg(F.max("heat_number").alias("_n"))
    offs = running_sum(per_day, ["pool"], ["pour_schedule_day"], "_n", "_prev", inclusive=False).drop("_n")
    df = df.join(offs, ["pool", "pour_schedule_day"], "left")
    return (df.withColumns({
        "global_heat_number": (F.col("_prev") + F.col("heat_number")).cast("int"),
        "heat_slot": slot_of("heat_number", reserved),
        "heat_status": F.when(F.col("heat_number") <= planned_heats_per_day, "Planned").otherwise("Overflow"),
    }).drop("_before", "_gheat", "_prev"))


def default_melt_plan(assignments: DataFrame, reference_date) -> DataFrame:
    """The plan without a producer: every chunk pours on its mold day, in heat 1."""
    rank = priority_rank(F.col("due_date"), reference_date)
    return assignments.withColumns({
        "original_pour_schedule_day": F.col("schedule_day"), "pour_schedule_day": F.col("schedule_day"),
        "heat_number": F.lit(1), "global_heat_number": F.lit(1), "heat_slot": F.lit(1), "heat_status": F.lit("Planned"),
        "days_until_due": days_until(F.col("due_date"), reference_date), "planning_priority_rank": rank,
        "planning_priority": priority_label(rank), "review_window": review_window(rank)})


def heat_summary(plan: DataFrame, reference_date) -> DataFrame:
    """One row per (pool, pour day, heat): slot, status, anchor alloy, group, due window,
    weight, molds, rows, jobs and extensions (sorted, comma separated)."""
    g = plan.groupBy("pool", "pour_schedule_day", "heat_number").agg(
        F.first("heat_slot").alias("heat_slot"),
        F.first("global_heat_number").alias("global_heat_number"),
        F.first("heat_status").alias("heat_status"),
        F.min("planning_priority_rank").alias("_rank"),
        F.min("alloy").alias("anchor_alloy"),
        F.min("compatibility_group").alias("compatibility_group"),
        F.min("due_date").alias("earliest_due_date"),
        F.max("due_date").alias("latest_due_date"),
        F.sum("total_weight_per_ext").cast("double").alias("total_weight_lbs"),
        F.sum("molds_for_ext").cast("double").alias("total_molds"),
        F.count(F.lit(1)).alias("rows_in_heat"),
        F.array_join(F.array_sort(F.collect_set(F.trim("job_number"))), ", ").alias("jobs"),
        F.array_join(F.array_sort(F.collect_set(
            F.when(F.trim(F.col("ext")) != "", F.concat_ws("-", F.trim("job_number"), F.trim("ext")))
            .otherwise(F.trim("job_number")))), ", ").alias("extensions"))
    return g.withColumns({"planning_priority": priority_label("_rank"),
                          "review_window": review_window("_rank")}).drop("_rank")
