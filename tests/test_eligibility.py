"""Scheduler input, eligibility rules, reject counts and schedule-row expansion."""

import datetime as dt

from pyspark.sql import functions as F

from castplan.operators import eligibility, priority, quality

SCHEMA = "job_number string, hold string, job_type string, scheduled string, casting_type string, molds_needed int"


def test_eligibility_keeps_expected_rows(spark):
    rows = [(None, "NO", "", "NO", "L", 1), ("1001", "YES", "", "NO", "L", 1), ("1002", "NO", "IFA", "NO", "L", 1),
            ("1003", "NO", "", "YES", "L", 1), ("1004", "NO", "", "NO", "I", 1), ("1005", "NO", "", "NO", "L", 0),
            ("2000", "NO", "", "NO", "L", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = sorted(r["job_number"] for r in eligibility.eligible(df).collect())
    assert kept == ["1003", "2000"]
    counts = {r["reason"]: r["job_count"] for r in eligibility.reject_counts(df).collect()}
    assert counts == {"blank": 1, "hold": 1, "job_type": 1, "cast_type": 1, "no_molds": 1, "added": 2}


def test_blank_text_job_and_missing_molds_are_rejected(spark):
    df = spark.createDataFrame([("  ", "NO", "", "NO", "L", 3), ("7", " yes ", "", "NO", "L", 3),
                                ("8", "NO", "", "NO", "L", None)], SCHEMA)
    r = {x["job_number"]: x["reject_reason"] for x in eligibility.reject_reason(df).collect()}
    assert r == {"  ": "blank", "7": "hold", "8": "no_molds"}


def test_scheduler_input_molds_needed_and_defaults(spark):
    df = spark.createDataFrame([("J1", 10.0, 3.0, "NO"), ("J2", 2.0, 5.0, None), ("J3", 4.0, None, "YES")],
                               "job_number string, quantity_of_molds double, molds_completed double, on_hold string")
    out = {r["job_number"]: r for r in eligibility.scheduler_input(df).collect()}
    assert out["J1"]["molds_needed"] == 7 and out["J2"]["molds_needed"] == 0 and out["J3"]["molds_needed"] == 4
    assert out["J1"]["hold"] == "NO" and out["J2"]["hold"] == "NO" and out["J3"]["hold"] == "YES"
    assert out["J1"]["scheduled"] == "NO"
    ignored = {r["job_number"]: r["hold"] for r in eligibility.scheduler_input(df, honor_hold=False).collect()}
    assert ignored["J3"] == "NO"


def test_schedule_rows_expand(spark):
    df = spark.createDataFrame([("J1", 24.0, 200.0, "L", "A"), ("J2", 0.0, 50.0, "L", "A"), ("J3", 2.2, -5.0, "F", "B")],
                               "job_number string, molds_needed double, pour_weight double, casting_type string, alloy string")
    out = {r["job_number"]: r for r in eligibility.schedule_rows(df).collect()}
    assert set(out) == {"J1", "J3"}
    assert out["J1"]["molds_for_ext"] == 24 and out["J1"]["total_weight_per_ext"] == 4800
    assert out["J1"]["ext"] == "" and out["J1"]["extension_seq"] == 0
    assert out["J3"]["molds_for_ext"] == 3 and out["J3"]["total_weight_per_ext"] == 0


def test_house_accounts_excluded(spark):
    df = spark.createDataFrame([("Customer",), (" house account ",), (None,)], "customer_name string")
    assert sorted(str(r[0]) for r in quality.exclude_customers(df).collect()) == ["Customer", "None"]
    names = spark.createDataFrame([("customer",)], "name string")
    assert quality.exclude_customers_df(df, names).count() == 2


def test_validation_raises_with_column_names(spark):
    df = spark.createDataFrame([(None, "C", "", "J1"), (dt.date(2026, 8, 4), "C", "P", "J2")],
                               "due_date date, customer_name string, part_number string, job_number string")
    try:
        quality.validate_rows(df)
        raise AssertionError("expected failure")
    except RuntimeError as exc:
        assert "due_date: 1 blank rows" in str(exc) and "part_number: 1 blank rows" in str(exc)
    empty = df.limit(0)
    try:
        quality.validate_rows(empty)
        raise AssertionError("expected failure")
    except RuntimeError as exc:
        assert "no rows" in str(exc)
    ok = df.where(F.col("job_number") == "J2")
    assert quality.validate_rows(ok) is ok


def test_priority_windows(spark):
    df = spark.createDataFrame([("J1", "2026-08-12", 0, 0), ("J2", "2026-09-30", 0, 0), ("J3", None, 0, 0),
                                ("J4", "2027-01-01", 0, 0)],
                               "job_number string, due_date string, extension_seq int, pool int")
    out = {r["job_number"]: r for r in priority.prioritize(df, dt.date(2026, 8, 10)).collect()}
    assert out["J1"]["planning_priority"] == "Highest Priority" and out["J1"]["days_until_due"] == 2
    assert out["J2"]["planning_priority"] == "Priority Review" and out["J2"]["review_window"] == "Next 10 Weeks"
    assert out["J3"]["planning_priority_rank"] == 2 and out["J3"]["planning_seq"] == 4
    assert [out[j]["planning_seq"] for j in ("J1", "J2", "J4")] == [1, 2, 3]


def test_report_source_and_seed(spark, tmpdir_path):
    from castplan.operators import capacity
    from castplan.plans.schedule import load_scheduler_input
    p = f"{tmpdir_path}/oor.csv"
    with open(p, "w") as fh:
        fh.write(" Job Number ,Alloy,Molds Needed,Hold,Scheduled,Casting Type,Job Type,Due Date\n"
                 "J1,economy,3,NO,NO,L,JOB,2001-06-20\nJ2,LARGE,0,NO,NO,L,JOB,2001-07-01\n")
    inp = load_scheduler_input(spark, "report", report_path=p)
    got = {r["job_number"]: (r["molds_needed"], r["compatibility_group"], r["due_date"]) for r in inp.collect()}
    assert got == {"J1": (3, "G1", dt.date(2001, 6, 20)), "J2": (0, "LARGE", dt.date(2001, 7, 1))}
    try:
        load_scheduler_input(spark, "ftp")
        raise AssertionError("expected failure")
    except RuntimeError as exc:
        assert "Unsupported" in str(exc)
    rows = eligibility.schedule_rows(eligibility.eligible(inp))
    empty = rows.limit(0).withColumn("schedule_day", F.lit(1))
    seeded = capacity.seed_when_empty(empty, rows).collect()
    assert [(r["job_number"], r["pour_schedule_day"], r["heat_number"]) for r in seeded] == [("J1", 1, 1)]
