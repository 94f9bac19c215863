"""Column helpers: dates, numbers, flags, lists, statuses."""

import datetime as dt

from pyspark.sql import functions as F

from castplan import functions as CF
from castplan.operators.calendar import business_calendar, day_date


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_decode_erp_date(spark):
    df = spark.createDataFrame([("2001-02-03",), ("20010203",), ("73000",), ("junk",), ("82400 ",), (None,)], "x string")
    got = [r[0] for r in df.select(CF.decode_erp_date("x")).collect()]
    assert got[0] == dt.date(2001, 2, 3) and got[1] == dt.date(2001, 2, 3)
    assert got[2] == dt.date(1800, 12, 28) + dt.timedelta(days=73000)
    assert got[3] is None and got[5] is None
    assert got[4] == dt.date(1800, 12, 28) + dt.timedelta(days=82400)


def test_decode_erp_date_reads_real_days_without_formatters(spark):
    texts = {"2000-02-29": dt.date(2000, 2, 29), "2001-02-29": None, "2001-02-03T08:30:00": dt.date(2001, 2, 3), "2001-02-03 08:30:00.5": dt.date(2001, 2, 3),
             "2001-02-03xyz": None, "2001-13-01": None, "20000229": dt.date(2000, 2, 29), "20010229": None, "20010203 rush": dt.date(2001, 2, 3),
             "99991231": dt.date(9999, 12, 31), "00010101": dt.date(1, 1, 1), "2001-2-3": None, "-400": dt.date(1800, 12, 28) - dt.timedelta(days=400)}
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", CF.decode_erp_date("x").alias("d"))
    # a packed text that is no day is a number of days, if it is in range
    assert {r["x"]: r["d"] for r in df.collect()} == texts
    assert "gettimestamp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_business_days_match_stepping(spark):
    start = dt.date(2026, 8, 1)
    rows = []
    for k in range(14):
        for n in range(-12, 13):
            rows.append((start + dt.timedelta(days=k), n))
    df = spark.createDataFrame(rows, "d date, n int").select("d", "n", CF.add_business_days("d", "n").alias("r"))

    def step(d, n):
        if n == 0:
            return d
        s = 1 if n > 0 else -1
        for _ in range(abs(n)):
            d += dt.timedelta(days=s)
            while d.weekday() > 4:
                d += dt.timedelta(days=s)
        return d
    for r in df.collect():
        assert r["r"] == step(r["d"], r["n"]), (r["d"], r["n"])


def test_calendar_skips_weekends(spark):
    days = spark.createDataFrame([(3,)], "day int")
    cal = {r["day"]: (r["date"], r["weekday"]) for r in business_calendar(days, dt.date(2026, 8, 14)).collect()}
    assert [cal[d][1] for d in (1, 2, 3)] == ["Friday", "Monday", "Tuesday"]
    assert one(spark, day_date(F.lit(4), dt.date(2026, 8, 15))) == dt.date(2026, 8, 20)


def test_numbers_and_text(spark):
    assert float(one(spark, CF.text_to_decimal(F.lit("$1,234.50")))) == 1234.5
    assert float(one(spark, CF.text_to_decimal(F.lit("n/a")))) == 0
    assert one(spark, CF.canonical_number_text(F.lit("1,200.500"))) == "1200.5"
    assert one(spark, CF.canonical_number_text(F.lit("12.000"))) == "12"
    assert one(spark, CF.canonical_number_text(F.lit("abc"))) is None
    assert one(spark, CF.plain_text(F.lit(None).cast("string"))) == ""
    assert one(spark, CF.plain_text(F.lit(dt.date(2026, 8, 4)), is_date=True)) == "2026-08-04"
    assert one(spark, CF.ceil_int(F.lit("2.1"))) == 3 and one(spark, CF.ceil_int(F.lit("x"))) == 0
    assert one(spark, CF.hold_flag(F.lit(" þ "))) == "YES" and one(spark, CF.hold_flag(F.lit("o"))) == "NO"
    assert float(one(spark, CF.total_pour_fallback(F.lit(0), F.lit(10), F.lit(5)))) == 50


def test_flags_and_lists(spark):
    assert one(spark, CF.yes_flag(F.lit(" y "))) is True
    assert one(spark, CF.yes_flag(F.lit(""), default=True)) is True
    assert one(spark, CF.yes_flag(F.lit("no"), default=True)) is False
    assert one(spark, CF.normalize_alloy_list(F.lit("cf8m, ,CF8M, wcb ,cf3m"))) == "CF8M, WCB, CF3M"


def test_statuses(spark):
    df = spark.createDataFrame([(None,), (5,), (15,), (30,)], "b int")
    got = [tuple(r) for r in df.select(CF.risk_status("b"), CF.ship_buffer_band("b")).collect()]
    assert got == [("UNKNOWN", "gray"), ("AT RISK", "green"), ("WATCH", "green"), ("ON TRACK", "green")]
    assert one(spark, CF.two_week_status(F.lit(0), F.lit(0))) == "EXCEPTION - NO TIME"
    assert one(spark, CF.two_week_status(F.lit(0), F.lit(30))) == "VIOLATION"
    assert one(spark, CF.schedule_status(F.lit(10), F.lit(4))) == "Partially Scheduled"
    assert one(spark, CF.on_time_status(F.lit("Scheduled"), F.lit(-1))) == "NO"
    assert one(spark, CF.capacity_label("L", F.lit(12), 30)) == "L=12/30"
    assert one(spark, CF.breakout_text(F.lit("5001"), F.lit("A"), F.lit(dt.date(2026, 8, 4)), F.lit(2))) == \
        "5001-A | Due 08/04/2026 | Molds 2"
    assert one(spark, CF.date_range_text(F.lit(dt.date(2026, 8, 4)), F.lit(dt.date(2026, 8, 5)))) == \
        "08/04/2026 - 08/05/2026"
