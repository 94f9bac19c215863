"""Row numbers in source order, first-seen names, sheets in their order, reserved slots."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from castplan import session
from castplan.operators import capacity, eligibility, heats, prefix
from castplan.operators.ordinal import file_ordinal, names_in_order, sorted_ordinal
from castplan.plans import heat_reports, melt_reports, presentation, publication, shipping
from castplan.plans.schedule import load_scheduler_input
from castplan.sources.files import read_open_order_report

REF = dt.date(2026, 8, 10)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_file_ordinal_is_gapless_over_many_splits(spark, tmpdir_path, fmt):
    path = f"{tmpdir_path}/in"
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "repeat('x', 40) AS pad")
    rows.write.option("header", True).format(fmt).save(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = file_ordinal(spark.read.option("header", True).format(fmt).load(path)).select(F.col("id").cast("long"), "row_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["row_seq"] for r in got) == list(range(1, 5001))
    if fmt == "csv":  # part files by name hold the ids in order
        assert all(r["id"] + 1 == r["row_seq"] for r in got)


def test_sorted_ordinal(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, "a", "b", "c"]), rnd.randint(0, 5), i) for i in range(700)]
    got = sorted_ordinal(spark.createDataFrame(rows, "k string, v int, i int"), ["k", F.col("v").desc()]).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", -r[1], r[2]))
    assert [(r["k"], r["v"], r["i"]) for r in sorted(got, key=lambda r: r["row_seq"])] == want
    assert [r["row_seq"] for r in sorted(got, key=lambda r: r["row_seq"])] == list(range(1, 701))
    assert sorted_ordinal(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_first_customer_and_lists_follow_the_report_file(spark, tmpdir_path):
    path = f"{tmpdir_path}/report.csv"
    with open(path, "w") as fh:
        fh.write("Due Date,Job Number,Casting Type,Pour Weight,Molds Needed,Hold,Alloy,Job Type,Customer Name\n")
        fh.write("2026-08-20,J1,L,10,2,NO,A,JOB, \n2026-08-20,J1,L,10,3,NO,A,JOB,Zed\n2026-08-20,J1,L,10,2,NO,A,JOB,Abe\n2026-08-19,J9,L,10,2,NO,A,JOB,Abe\n")
    inp = load_scheduler_input(spark, "report", report_path=path)
    assert [r["row_seq"] for r in read_open_order_report(spark, path).orderBy("row_seq").collect()] == [1, 2, 3, 4]
    for parts in (1, 7):  # whatever the order of arrival
        rows = eligibility.schedule_rows(eligibility.eligible(inp.repartition(parts, F.rand(parts))))
        asg = capacity.mold_assignments(rows, REF)
        outlook = shipping.job_shipping_outlook(rows, asg, REF)
        assert {r["job_number"]: r["customer_name"] for r in outlook.collect()} == {"J1": "Zed", "J9": "Abe"}
        plan = heats.default_melt_plan(asg, REF)
        m = melt_reports.melt_management(heat_reports.heat_summary_rows(plan, REF, REF), plan, REF).orderBy("pour_schedule_day").first()
        # priority order: J9 is due first; then J1's rows, fewest molds first, in file order
        assert (m["customers"], m["poured_job_ids"]) == ("Abe, Zed", "J9, J1")


def test_names_in_order(spark):
    df = spark.createDataFrame([("h", 3, "b "), ("h", 1, "z"), ("h", 2, "b"), ("h", 4, "z"), ("h", 5, " "), ("g", 1, None), (None, 2, "q")], "k string, o int, n string")
    got = {r["k"]: r["names"] for r in names_in_order(df, ["k"], {"names": "n"}, F.struct("o")).collect()}
    assert got == {"h": "z, b", "g": "", None: "q"}


def test_sheets_are_written_in_order(spark, tmpdir_path):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 3), rnd.randint(1, 9), rnd.choice(["detail", "total"]), rnd.choice([None, "A", "B"]), dt.date(2026, 8, rnd.randint(1, 28)), f"J{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "pool int, schedule_day int, row_type string, alloy string, due_date date, job_number string").repartition(9)
    sheets = {"days": presentation.day_rows_order(df), "open": presentation.open_orders_order(df)}
    for fmt in ("parquet", "csv"):
        paths = publication.publish_sheets(sheets, f"{tmpdir_path}/{fmt}", fmt)
        read = {name: [j for f in sorted(glob.glob(f"{p}/part-*")) for j in
                       [r["job_number"] for r in spark.read.option("header", True).format(fmt).load(f).coalesce(1).collect()]] for name, p in paths.items()}
        assert read["days"] == [r[5] for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] is None, r[3] or "", r[4], r[5]))]
        assert read["open"] == [r[5] for r in sorted(rows, key=lambda r: (r[4], r[5]))]
    back = publication.read_sheets(spark, {"open": f"{tmpdir_path}/parquet/open"})["open"]
    assert [r["job_number"] for r in back.orderBy("position").collect()] == read["open"]


def test_sheets_are_numbered_without_a_copy(spark, tmpdir_path):
    spark.range(0, 5000, 1, 7).selectExpr("id", "repeat('x', 40) AS pad").write.parquet(f"{tmpdir_path}/sheet")
    spark.range(0).write.parquet(f"{tmpdir_path}/empty")
    kept = len(session._STORED)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        sheets = publication.read_sheets(spark, {"sheet": f"{tmpdir_path}/sheet", "empty": f"{tmpdir_path}/empty"})
        got = sheets["sheet"].collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(session._STORED) == kept  # nothing is written before or while a sheet is read
    assert [(r["id"], r["position"]) for r in sorted(got, key=lambda r: r["position"])] == [(i, i + 1) for i in range(5000)]
    assert got[0]["pad"] == "x" * 40 and sheets["sheet"].columns == ["id", "pad", "position"] and sheets["empty"].count() == 0


def test_reserved_slots_are_set_aside(spark):
    rows = [(0, f"J{i}", "A", f"G{i}", 1, 100, 1, i, "", dt.date(2026, 8, 20), "C") for i in range(1, 8)]
    asg = spark.createDataFrame(rows, "pool int, job_number string, alloy string, compatibility_group string, schedule_day int, total_weight_per_ext long, "
                                      "molds_for_ext int, priority_seq int, ext string, due_date date, customer_name string")
    plan = heats.melt_plan(asg, REF, reserved=(2, 6))
    assert [r["heat_slot"] for r in plan.orderBy("heat_number").collect()] == [1, 3, 4, 5, 7, 8, 9]
    summary = heat_reports.heat_summary_rows(plan, REF, REF, (2, 6))
    held = summary.where("heat_status = 'Reserved'").orderBy("heat_slot").collect()
    assert [r["heat_slot"] for r in held] == [2, 6] and {(r["heat_number"], r["jobs"], r["total_molds"]) for r in held} == {(None, "", 0.0)}
    assert sorted(r["heat_slot"] for r in heat_reports.heat_planner_rows(summary).collect()) == list(range(1, 10))
    totals = heat_reports.heat_daily_totals(summary).collect()
    assert len(totals) == 1 and totals[0]["total_heats"] == 7 and totals[0]["planned_heats"] + totals[0]["overflow_heats"] == 7
    assert melt_reports.melt_management(summary, plan, REF).count() == 7


def test_range_bounds_are_found_by_the_sort_keys_alone(spark):
    """Samples of the range go to the driver, so the other columns only sort inside a slice."""
    import contextlib
    import io

    seen = []
    rows = spark.createDataFrame([(i // 2, f"text {(i * 7) % 40}", "wide" * 50) for i in range(40)], "k int, t string, wide string")
    kept, prefix.store = prefix.store, lambda df, name: seen.append(df) or kept(df, name)
    try:
        out = sorted_ordinal(rows, ["k"])
    finally:
        prefix.store = kept
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        seen[0].explain()
    assert "wide" not in next(line for line in buf.getvalue().splitlines() if "rangepartitioning" in line)
    numbered = [(r.k, r.t) for r in out.orderBy("row_seq").collect()]
    assert numbered == sorted(numbered) and [r.row_seq for r in out.orderBy("row_seq").collect()] == list(range(1, 41))
