"""Report operators on small hand-made frames (restating the planning tool's examples)."""

import datetime as dt

from pyspark.sql import functions as F

from castplan.operators.heats import melt_plan
from castplan.plans import heat_reports, melt_reports, mold_reports, shipping

START = dt.date(2026, 8, 4)  # day 1 = Tuesday 2026-08-04
D = dt.date.fromisoformat


def test_shipping_outlook_statuses(spark):
    planned = spark.createDataFrame([(0, "5001", D("2026-08-20"), 2, "Cust", 0), (0, "5002", D("2026-08-18"), 1, "", 0)],
                                    "pool int, job_number string, due_date date, molds_for_ext int, customer_name string, extension_seq int")
    asg = spark.createDataFrame([(0, "5001", 2, 1, 2)],
                                "pool int, job_number string, molds_for_ext int, schedule_day int, pour_schedule_day int")
    out = {r["job_number"]: r for r in shipping.job_shipping_outlook(planned, asg, START).collect()}
    assert out["5001"]["schedule_status"] == "Scheduled"
    assert out["5001"]["expected_ship_date"] == D("2026-08-19")
    assert out["5001"]["ship_buffer_days"] == 1 and out["5001"]["on_time"] == "YES"
    assert out["5002"]["schedule_status"] == "Not Yet Scheduled" and out["5002"]["on_time"] == "NOT SCHEDULED"
    assert out["5002"]["customer_name"] == ""
    st = {r["job_number"]: r["on_time_band"] for r in shipping.job_status(shipping.job_shipping_outlook(planned, asg, START)).collect()}
    assert st == {"5001": "green", "5002": "orange"}


PLAN_SCHEMA = ("pool int, pour_schedule_day int, schedule_day int, original_pour_schedule_day int, heat_number int, "
               "alloy string, job_number string, ext string, molds_for_ext int, total_weight_per_ext long, "
               "part_number string, casting_type string, customer_name string, due_date date")


def test_molds_on_floor_resets_per_heat_run(spark):
    plan = spark.createDataFrame([
        (0, 1, 1, 1, 1, "LEW15", "5001", "A", 2, 600, "P1", "L", "C1", D("2026-08-04")),
        (0, 1, 1, 1, 1, "LEW15", "5002", "B", 3, 700, "P2", "L", "C2", D("2026-08-04")),
        (0, 1, 1, 1, 2, "LEW15", "5003", "C", 1, 500, "P3", "L", "C3", D("2026-08-04"))], PLAN_SCHEMA)
    rows = {r["job_number"]: r for r in melt_reports.melt_schedule(plan, START).collect()}
    assert [rows[j]["molds_on_floor"] for j in ("5001", "5002", "5003")] == [0, 2, 0]
    assert rows["5001"]["pour_date"] == D("2026-08-05") and rows["5001"]["weekday"] == "Tuesday"


def test_melt_capacity_labels(spark):
    plan = spark.createDataFrame([
        (0, 1, 1, 1, 1, "A", "J1", "", 2, 600, "P", "L", "C", None),
        (0, 1, 1, 1, 2, "A", "J2", "", 2, 400, "P", "L", "C", None)], PLAN_SCHEMA)
    r = melt_reports.melt_capacity(plan).first()
    assert r["heat_capacity"] == "Heats=2/5" and r["weight_capacity"] == "Lbs=1000/10000"


def test_gap_diagnostics_finds_skipped_days(spark):
    plan = spark.createDataFrame([
        (0, 1, 1, 1, 1, "A", "J1", "", 30, 100, "P", "L", "C", None),
        (0, 3, 2, 2, 1, "A", "J2", "", 30, 100, "P", "L", "C", None)], PLAN_SCHEMA)
    out = melt_reports.melt_gap_diagnostics(plan, START).collect()
    assert len(out) == 1
    r = out[0]
    assert r["skipped_pour_day"] == 2 and r["original_heats_on_day"] == 1 and r["heats_pushed_later"] == 1
    assert r["pushed_to_pour_days"] == "3" and r["window_line_usage"] == "30/30"
    assert r["likely_cause"].startswith("Original heats were pushed later because line mold capacity")
    assert r["skipped_pour_date"] == D("2026-08-05")


def test_heat_summary_two_week_rule_and_breakout(spark):
    asg = spark.createDataFrame([
        (0, 1, "LEW15", "G", "5001", "A", 2, 600, D("2026-08-04"), "Cust", "P1", "L", 0),
        (0, 1, "LEW15", "G", "5001", "B", 2, 600, D("2026-08-05"), "Cust", "P1", "L", 1)],
        "pool int, schedule_day int, alloy string, compatibility_group string, job_number string, ext string, "
        "molds_for_ext int, total_weight_per_ext long, due_date date, customer_name string, part_number string, "
        "casting_type string, extension_seq int")
    plan = melt_plan(asg, D("2026-08-01"), furnace_every_n_days=1)
    s = heat_reports.heat_summary_rows(plan, START, D("2026-08-01")).collect()
    assert len(s) == 1
    h = s[0]
    assert h["pour_buffer_days"] == 0 and h["max_mold_lead_days"] == 0 and h["avg_mold_lead_days"] == 0.0
    assert h["two_week_rule_status"] == "EXCEPTION - NO TIME"
    assert h["job_breakout"] == "5001-A | Due 08/04/2026 | Molds 2; 5001-B | Due 08/05/2026 | Molds 2"
    assert h["extensions"] == "5001-A, 5001-B" and h["total_weight_lbs"] == 1200
    tot = heat_reports.heat_daily_totals(heat_reports.heat_summary_rows(plan, START, D("2026-07-01"))).first()
    assert tot["total_heats"] == 1 and tot["planned_heats"] == 1 and tot["total_molds"] == 4


def test_daily_schedule_totals_rows(spark):
    asg = spark.createDataFrame([
        (0, 1, 1, "5001", "", "A", "L", D("2026-08-20"), 2, 20, 10.0),
        (0, 1, 1, "5002", "", "B", "F", None, 3, 30, 10.0),
        (0, 2, 2, "5001", "", "A", "L", D("2026-08-20"), 1, 10, 10.0)],
        "pool int, schedule_day int, pour_schedule_day int, job_number string, ext string, alloy string, "
        "casting_type string, due_date date, molds_for_ext int, total_weight_per_ext long, pour_weight double")
    for c in ("customer_name", "part_number", "quantity_of_molds", "castings_per_mold", "quantity_of_cores"):
        asg = asg.withColumn(c, F.lit(None).cast("string"))
    asg = asg.withColumn("heat_number", F.lit(1))
    d = mold_reports.daily_mold_schedule(asg, START)
    totals = {r["schedule_day"]: (r["molds_for_ext"], r["total_weight_per_ext"]) for r in d.where("row_type = 'total'").collect()}
    assert totals == {1: (5, 50), 2: (1, 10)}
    detail = {r["job_number"]: r for r in d.where("row_type = 'detail' AND schedule_day = 1").collect()}
    assert detail["5001"]["pour_buffer_days"] == 16 and detail["5001"]["due_buffer_status"] == "WATCH"
    assert detail["5002"]["due_buffer_status"] == "UNKNOWN"
    cap = {r["schedule_day"]: (r["line_capacity"], r["floor_capacity"]) for r in mold_reports.mold_capacity(asg).collect()}
    assert cap[1] == ("L=2/30", "F=3/3")
    summ = mold_reports.day_summary(asg).where("schedule_day = 1").first()
    assert summ["unique_jobs"] == 2 and summ["total_molds"] == 5 and summ["total_row_weight"] == 50
