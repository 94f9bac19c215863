"""What a run leaves on disk between its steps: the dashboard from the catalog, its exports and its shuffles."""

import datetime as dt
import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from castplan import session
from castplan.operators import open_orders as oo
from castplan.plans import registry
from castplan.sources.adapter import ErpViews

DETAIL = "order_number long, job_number string, quantity_ordered decimal(18,4), pieces_shipped_to_date decimal(18,4), extended_order_value decimal(18,4)"
HEADER = "order_number long, customer_po string, ship_date date, job_number string"


def _day(n):
    return dt.date(2001, 1, n)


@pytest.fixture()
def erp(spark):
    detail = spark.createDataFrame([(1, " j1", 2, 1, 10), (1, " j1", 2, 1, 10), (1, "  ", None, None, 5), (2, "J1", 1, 0, None), (2, None, 7, 7, 7),
                                    (3, "j3 ", 4, 0, 4), (4, "J4", 1, 1, 1), (None, "J5", 1, 1, 1)], DETAIL.replace("decimal(18,4)", "int"))
    detail = detail.select(*[F.col(c).cast("decimal(18,4)") if c.endswith(("ordered", "date", "value")) else F.col(c) for c in detail.columns])
    header = spark.createDataFrame([(1, "PO-1", _day(1), "j7"), (1, "PO-9", _day(2), None), (2, "PO-10", None, " "), (3, " ", _day(3), "J1"),
                                    (None, "PO-5", _day(5), "J5")], HEADER)
    return ErpViews(header, detail, None, None, None)


def _rows(df):
    return {r["job_key"]: (r["customer_po"], float(r["quantity_ordered"]), float(r["quantity_shipped_to_date"]), r["ship_date"], float(r["total_value"]))
            for r in df.collect()}


def test_roll_up_of_written_unwritten_and_kept_lines(spark, erp, tmpdir_path):
    want = {"J1": ("PO-9", 9.0, 4.0, _day(2), 40.0), "J7": ("PO-1", 0.0, 0.0, _day(1), 5.0), "J3": (None, 4.0, 0.0, _day(3), 4.0)}
    assert _rows(oo.orders_by_job_history(erp)) == want
    assert _rows(oo.orders_by_job_history(oo.materialize_order_lines(erp, f"{tmpdir_path}/lines"))) == want
    kept = len(session._STORED)
    with session.steps(spark) as keep:
        rows = oo.orders_by_job_history(erp, keep)
        path = session._STORED[-1][1]
        assert _rows(rows) == want and os.path.isdir(path)
    assert len(session._STORED) == kept and not os.path.exists(path)


def test_order_lines_go_to_their_job_in_one_shuffle(spark, erp):
    rows = oo.orders_by_job_history(erp)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(job_key") == 1 and "po#" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning(job_key" in x)


def _shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    df = spark.range(10_000, numPartitions=4).groupBy((F.col("id") % 97).alias("k")).count()
    rows, until = session.store(df, "shuffled"), time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:  # Spark deletes them in a thread of its own
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert rows.count() == 97


def _tables(spark, root):
    """Four small tables of the driver's schema: 40 parts, of which some orders share."""
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    write([(k, f"C{k}") for k in range(1, 101)], "c_custkey long, c_name string", "customer")
    write([(k, k % 40, 100.0 + k, "SMALL", "B1") for k in range(2, 42)], "p_partkey long, p_size int, p_retailprice double, p_type string, p_brand string", "part")
    write([(k, k % 100 + 1, f"2001-01-{k % 28 + 1:02d}") for k in range(1, 31)], "o_orderkey long, o_custkey long, o_orderdate string", "orders")
    write([(o, n, (o * 3 + n) % 40 + 2, n, float(n), 2.0 * o, "F" if n % 2 else "O", f"2001-02-{n:02d}") for o in range(1, 31) for n in range(1, 5)],
          "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_linestatus string, l_shipdate string", "lineitem")


def test_dashboard_from_catalog_writes_no_order_lines_and_keeps_no_export(spark, tmpdir_path, monkeypatch):
    def written(*_):
        raise AssertionError("the dashboard reads the order lines once")
    _tables(spark, tmpdir_path)
    want = {r["job_number"]: r for r in oo.dashboard_history(oo.materialize_order_lines(registry.erp_views(spark, tmpdir_path), f"{tmpdir_path}-lines"),
            registry.shared_orders(spark, tmpdir_path).where("dayofmonth(due_date) % 2 = 0").withColumn("run_id", F.lit(2)), None, 2).collect()}
    monkeypatch.setattr(registry, "_MEMO", {})
    monkeypatch.setattr(registry, "oo", SimpleNamespace(**{**vars(oo), "materialize_order_lines": written}))
    folder = f"{session.ensure_checkpoint_dir(spark)}/castplan-{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder))
    got = {r["job_number"]: r for r in registry.QUERIES["dashboard_from_catalog"](spark, tmpdir_path).collect()}
    new = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert new == {"assembled-orders", "history", "history-by-job"}
    assert got.keys() == want.keys() and len(got) > 5
    for job, r in got.items():
        assert r["source"] == "history"
        assert [r[c] for c in ("customer_po", "ship_date")] == [want[job][c] for c in ("customer_po", "ship_date")]
        assert [r[c] for c in ("quantity_ordered", "total_value")] == [float(want[job][c]) for c in ("quantity_ordered", "total_value")]
