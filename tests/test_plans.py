"""Plan shape: no cartesian or nested-loop joins, no row-at-a-time Python, pushdown reaches scans."""

import contextlib
import io

import __spark_entry__ as E
from conftest import SF_SMALL
from castplan.operators import capacity
from castplan.plans.schedule import ScheduleParams, build_schedule
from castplan.operators.open_orders import order_lines
from castplan.sources.adapter import erp_views


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_no_cartesian_or_row_python(spark):
    for name, fn in E.queries().items():
        text = plan_text(fn(spark, SF_SMALL))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert bad not in text, (name, bad)


def test_allocation_is_one_grouped_map_over_narrow_sorted_rows(spark):
    s = build_schedule(spark, SF_SMALL, ScheduleParams())
    text = plan_text(capacity.allocate(s.schedule_rows, ScheduleParams().reference_date))
    text = text.split("\n\n")[0]  # the operator tree (details follow after a blank line)
    assert text.count("FlatMapGroupsInPandas") == 1
    assert "ArrowEvalPython" not in text
    # exactly one sort feeds the grouped map: the priority sort, not a re-sort by pool
    head = text.split("FlatMapGroupsInPandas")[1].split("Exchange")[0]
    assert head.count("Sort (") == 1, head


def test_filter_and_projection_reach_the_scan(spark):
    from pyspark.sql import functions as F
    lines = order_lines(erp_views(spark, SF_SMALL)).where(F.col("d.line_number") == 1).select("d.order_number")
    text = plan_text(lines)
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,1), IsNotNull(l_orderkey)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text


def test_dashboard_source_comes_from_the_catalog(spark):
    from castplan.operators.open_orders import dashboard_rows
    from castplan.sources.adapter import erp_views, order_snapshot, scheduler_run
    erp = erp_views(spark, SF_SMALL)
    assert dashboard_rows(spark, erp)[0] == "live"
    order_snapshot(spark, SF_SMALL).createOrReplaceTempView("order_snapshot")
    scheduler_run(spark, SF_SMALL).createOrReplaceTempView("scheduler_run")
    try:
        kind, rows = dashboard_rows(spark, erp)
        assert kind == "history" and len(rows.columns) == 12 and rows.count() > 0
    finally:
        for v in ("order_snapshot", "scheduler_run"):
            spark.catalog.dropTempView(v)


def test_sheet_orders_and_small_defaults(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from castplan.functions.clean import first_nonblank
    from castplan.functions.dates import reference_date_or_today
    from castplan.plans import presentation as P
    d = dt.date
    df = spark.createDataFrame([(1, 1, "B", d(2026, 8, 2), "J2", "Late"), (1, 1, None, d(2026, 8, 1), "J1", "Late"), (1, 1, "A", None, "J4", "Ok"),
                                (1, 1, "A", d(2026, 8, 3), "J3", None)], "pool int, schedule_day int, alloy string, due_date date, job_number string, schedule_status string")
    jobs = lambda x: [r["job_number"] for r in x.collect()]
    assert jobs(P.open_orders_order(df)) == ["J1", "J2", "J3", "J4"]
    assert jobs(P.day_rows_order(df)) == ["J3", "J4", "J2", "J1"]
    assert jobs(P.alloy_order(df, "alloy", ("job_number",))) == ["J3", "J4", "J2", "J1"]
    assert jobs(P.shipping_order(df)) == ["J1", "J2", "J4", "J3"]
    blanks = spark.createDataFrame([(" ", None, "x"), (None, "y", "z")], "a string, b string, c string")
    assert [r[0] for r in blanks.select(first_nonblank(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["x", "y"]
    assert reference_date_or_today("2026-08-10") == d(2026, 8, 10) and reference_date_or_today("bad") == reference_date_or_today(None) == d.today()
