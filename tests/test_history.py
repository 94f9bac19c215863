"""History sinks and the streaming snapshot driver (written under a scratch folder)."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from castplan.schemas import OPEN_ORDER_HEADERS
from castplan.sources import catalog, history
from castplan.sources.files import read_snapshot_csv
from castplan.sources.loads import Load, current, read
from castplan.streaming.snapshot_stream import ingest, snapshot_stream


def _csv(path, rows):
    with open(path, "w") as fh:
        fh.write(",".join(OPEN_ORDER_HEADERS) + "\n")
        for r in rows:
            fh.write(",".join(r) + "\n")


def _row(job, molds_done, due="2026-08-04"):
    return [due, "Customer", "P1", "JOB", job, "A", "L", "10", "10", "2", "1", "\"$1,100\"", "500", "1000", "H1",
            "3", molds_done, "NO"]


def test_snapshot_load_lifecycle_and_runs(spark, tmpdir_path):
    root = f"{tmpdir_path}/hist"
    p1, p2 = f"{tmpdir_path}/s1.csv", f"{tmpdir_path}/s2.csv"
    _csv(p1, [_row(" j1 ", "3"), _row("J2", "")])
    _csv(p2, [_row("J1", "5")])
    r1 = history.load_snapshot(spark, read_snapshot_csv(spark, p1), root, "2026-08-10", "erp")
    r2 = history.load_snapshot(spark, read_snapshot_csv(spark, p2), root, "2026-08-11", "erp")
    assert (r1, r2) == (1, 2)
    typed = read(spark, root, "order_snapshot")
    j1 = typed.where((F.col("run_id") == 1) & (F.col("job_number") == "J1")).first()
    assert float(j1["pour_weight"]) == 1100 and j1["due_date"] == dt.date(2026, 8, 4)
    life = {r["job_number"]: r for r in history.read_lifecycle(spark, root).collect()}
    assert life["J1"]["run_id"] == 2 and float(life["J1"]["molds_completed"]) == 5
    assert life["J1"]["first_seen_run"] == 1 and life["J1"]["runs_seen"] == 2
    assert life["J2"]["last_seen_run"] == 1
    runs = {r["run_id"]: r["row_count"] for r in read(spark, root, "scheduler_run").collect()}
    assert runs == {1: 2, 2: 1}
    # re-loading run 2 replaces its partitions (idempotent)
    history.load_snapshot(spark, read_snapshot_csv(spark, p2), root, "2026-08-11", "erp", run_id=2)
    assert read(spark, root, "order_snapshot_raw").where("run_id = 2").count() == 1
    again = {r["job_number"]: r for r in history.read_lifecycle(spark, root).collect()}
    assert again == life
    # a reload without J1 takes the job back to its earlier run
    p3 = f"{tmpdir_path}/s3.csv"
    _csv(p3, [_row("J7", "1")])
    history.load_snapshot(spark, read_snapshot_csv(spark, p3), root, "2026-08-11", "erp", run_id=2)
    life = {r["job_number"]: r for r in history.read_lifecycle(spark, root).collect()}
    assert set(life) == {"J1", "J2", "J7"} and life["J1"]["run_id"] == 1 and life["J1"]["runs_seen"] == 1


TABLES = ("order_lifecycle", "order_snapshot_raw", "order_snapshot", "scheduler_run")


def everything(spark, root):
    return {t: sorted(map(str, read(spark, root, t).collect())) for t in TABLES}


@pytest.mark.parametrize("step", [*TABLES, "commit"])
def test_failed_load_changes_nothing(spark, tmpdir_path, monkeypatch, step):
    root, p, q = f"{tmpdir_path}/hist", f"{tmpdir_path}/s.csv", f"{tmpdir_path}/q.csv"
    _csv(p, [_row("J1", "3")])
    _csv(q, [_row("J2", "4")])
    history.load_snapshot(spark, read_snapshot_csv(spark, p), root, "2026-08-10", "erp")
    before = everything(spark, root)
    write = Load.write

    def fail(self, df, table, *a):
        if table == step:
            raise RuntimeError("lost")
        return write(self, df, table, *a)

    def fail_commit(self):
        raise RuntimeError("lost")
    monkeypatch.setattr(Load, "write", fail)
    if step == "commit":
        monkeypatch.setattr(Load, "commit", fail_commit)
    for run_id in (None, 1):  # a new run, and the same again with other rows
        with pytest.raises(RuntimeError, match="lost"):
            history.load_snapshot(spark, read_snapshot_csv(spark, q), root, "2026-08-11", "erp", run_id=run_id)
        assert everything(spark, root) == before
    monkeypatch.undo()
    assert history.load_snapshot(spark, read_snapshot_csv(spark, q), root, "2026-08-11", "erp") == 2
    assert {r["job_number"] for r in history.read_lifecycle(spark, root).collect()} == {"J1", "J2"}


def test_a_run_loaded_again_leaves_nothing_behind(spark, tmpdir_path):
    root, p, blank = f"{tmpdir_path}/hist", f"{tmpdir_path}/s.csv", f"{tmpdir_path}/b.csv"
    _csv(p, [_row("J1", "3")])
    _csv(blank, [_row(" ", "3")])
    load = lambda path, **k: history.load_snapshot(spark, read_snapshot_csv(spark, path), root, "2026-08-10", "erp", run_id=1, **k)
    load(p)
    load(blank)
    assert [read(spark, root, t).count() for t in TABLES] == [0, 1, 0, 1]
    load(p)
    load(p, skip_transform=True)  # raw rows only: the typed rows of the run before are gone
    assert [read(spark, root, t).count() for t in TABLES] == [0, 1, 0, 1]
    with pytest.raises(RuntimeError, match="no data rows"):
        history.load_snapshot(spark, read_snapshot_csv(spark, p).limit(0), root, "2026-08-10", "erp", run_id=1)
    assert [read(spark, root, t).count() for t in TABLES] == [0, 1, 0, 1]


def test_a_load_scans_its_source_once_and_counts_it(spark, tmpdir_path):
    root, p = f"{tmpdir_path}/hist", f"{tmpdir_path}/s.csv"
    _csv(p, [_row(f"J{i}", "3") for i in range(40)])
    source = read_snapshot_csv(spark, p)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    history.load_snapshot(spark, source.mapInArrow(count, source.schema), root, "2026-08-10", "erp")
    assert seen.value == 40 and read(spark, root, "scheduler_run").first()["row_count"] == 40


def test_a_load_of_one_job_rewrites_one_bucket(spark, tmpdir_path):
    root, p, one = f"{tmpdir_path}/hist", f"{tmpdir_path}/s.csv", f"{tmpdir_path}/one.csv"
    _csv(p, [_row(f"J{i}", "3") for i in range(300)])
    _csv(one, [_row("J7", "9")])
    history.load_snapshot(spark, read_snapshot_csv(spark, p), root, "2026-08-10", "erp")
    before = current(spark, root)["order_lifecycle"]["live"]
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{root}/order_lifecycle/*/*/*.parquet")}
    history.load_snapshot(spark, read_snapshot_csv(spark, one), root, "2026-08-11", "erp")
    after = current(spark, root)["order_lifecycle"]["live"]
    assert len(before) > 25 and len([b for b in after if after[b] != before[b]]) == 1
    assert {f: os.path.getmtime(f) for f in files} == files and len(glob.glob(f"{root}/order_lifecycle/*/*/*.parquet")) == len(files) + 1
    life = {r["job_number"]: r for r in history.read_lifecycle(spark, root).collect()}
    assert len(life) == 300 and life["J7"]["runs_seen"] == 2 and life["J8"]["runs_seen"] == 1
    for _ in range(2):  # two loads on, the replaced bucket's folder is gone
        history.load_snapshot(spark, read_snapshot_csv(spark, one), root, "2026-08-11", "erp")
    assert len(glob.glob(f"{root}/_manifest/*.json")) == 2 and len(glob.glob(f"{root}/order_lifecycle/*/load=*")) == len(before) + 1


def test_two_loads_at_once(spark, tmpdir_path):
    root = f"{tmpdir_path}/hist"
    first, second = Load(spark, root), Load(spark, root)
    for load, n in ((first, 1), (second, 2)):
        load.write(history.run_row(spark, n, "2026-08-10", "erp", 1), "scheduler_run", "run_id", [n])
    first.commit()
    with pytest.raises(RuntimeError, match="another load"):
        second.commit()
    assert [r["run_id"] for r in read(spark, root, "scheduler_run").collect()] == [1]


def test_the_dashboard_finds_loaded_history(spark, tmpdir_path):
    from conftest import SF_SMALL
    from castplan.operators.open_orders import dashboard_rows
    from castplan.sources.adapter import erp_views
    root, database = f"{tmpdir_path}/hist", "loaded_history"
    erp = erp_views(spark, SF_SMALL)
    assert dashboard_rows(spark, erp, database)[0] == "live"
    for day, jobs in ((10, ["J1", "J2"]), (11, ["J2", "J3", "J4"]), (12, ["J1"])):
        p = f"{tmpdir_path}/s{day}.csv"
        _csv(p, [_row(j, "3") for j in jobs])
        history.load_snapshot(spark, read_snapshot_csv(spark, p), root, f"2026-08-{day}", "erp", database=database)
    history.load_snapshot(spark, read_snapshot_csv(spark, f"{tmpdir_path}/s10.csv"), root, "2026-08-12", "erp", run_id=3, database=database)
    kind, rows = dashboard_rows(spark, erp, database)
    assert kind == "history" and sorted(r["job_number"] for r in rows.collect()) == ["J1", "J2"]
    kind, rows = dashboard_rows(spark, erp, database, run_id=2)
    assert sorted(r["job_number"] for r in rows.collect()) == ["J2", "J3", "J4"]
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and spark.table(f"{database}.scheduler_run").count() == 3


def test_skip_transform_and_bad_csv(spark, tmpdir_path):
    root = f"{tmpdir_path}/hist2"
    p = f"{tmpdir_path}/s.csv"
    _csv(p, [_row("J9", "1")])
    history.load_snapshot(spark, read_snapshot_csv(spark, p), root, "2026-08-10", "erp", skip_transform=True)
    assert os.path.exists(f"{root}/order_snapshot_raw") and not os.path.exists(f"{root}/order_snapshot")
    bad = f"{tmpdir_path}/bad.csv"
    with open(bad, "w") as fh:
        fh.write("Due Date,Job Number\n2026-08-04,J1\n")
    try:
        read_snapshot_csv(spark, bad)
        raise AssertionError("expected failure")
    except RuntimeError as exc:
        assert "Customer Name" in str(exc)


def test_archive_publish_and_audit_retention(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert history.archive_report(spark, df, f"{tmpdir_path}/arch", "2026-08-10") == 1
    assert history.archive_report(spark, df, f"{tmpdir_path}/arch", "2026-08-10") == 2
    assert history.archive_report(spark, df, f"{tmpdir_path}/arch", "2026-08-11") == 1
    paths = history.write_reports({"mold_schedule": df, "job_status": df}, f"{tmpdir_path}/pub")
    assert all(spark.read.parquet(p).count() == 1 for p in paths)
    audit = spark.createDataFrame([(3,)], "missing_count long")
    for m in range(1, 15):
        out = history.append_audit(spark, audit, f"{tmpdir_path}/audit", dt.datetime(2025 + (m - 1) // 12, (m - 1) % 12 + 1, 5))
        files = {f: os.path.getmtime(f) for f in glob.glob(f"{tmpdir_path}/audit/*/*.parquet")}
        assert m == 1 or len(older & set(files.items())) >= min(len(older), 11)  # appended to, not rewritten
        older = set(files.items())
    months = sorted(r[0] for r in out.select("month").distinct().collect())
    assert len(months) == 12 and months[0] == "2025-03" and months[-1] == "2026-02"
    history.save_text_snapshot(spark.createDataFrame([(dt.date(2026, 8, 4), None)], "d date, s string"),
                               f"{tmpdir_path}/snap", "2026-08-10_120000")
    r = spark.read.parquet(f"{tmpdir_path}/snap").first()
    assert r["d"] == "2026-08-04" and r["s"] == ""


def test_catalog(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("cat_probe")
    assert "cat_probe" in [r["name"] for r in catalog.list_tables(spark, include_views=True).collect()]
    cols = catalog.list_columns(spark, "cat_probe").collect()
    assert cols[0]["name"] == "a" and cols[0]["ordinal"] == 1
    assert not catalog.history_available(spark)


def test_streaming_available_now(spark, tmpdir_path):
    landing = f"{tmpdir_path}/landing"
    os.makedirs(landing)
    _csv(f"{landing}/erp_2026-08-10.csv", [_row("J1", "3"), _row("J2", "1")])
    _csv(f"{landing}/erp_2026-08-11.csv", [_row("J1", "6")])
    _csv(f"{landing}/stray.csv", [_row("J5", "1")])
    q = snapshot_stream(spark, landing, f"{tmpdir_path}/root", f"{tmpdir_path}/ckpt")
    q.awaitTermination(300)
    life = {r["job_number"]: r for r in history.read_lifecycle(spark, f"{tmpdir_path}/root").collect()}
    assert life["J1"]["run_id"] == 20260811001 and float(life["J1"]["molds_completed"]) == 6
    assert life["J1"]["runs_seen"] == 2 and life["J2"]["last_seen_run"] == 20260810001 and "J5" not in life
    assert [r["file"].rsplit("/", 1)[1] for r in read(spark, f"{tmpdir_path}/root", "quarantine_files").collect()] == ["stray.csv"]
    # a new file is picked up by the next availableNow run
    _csv(f"{landing}/erp_2026-08-12.csv", [_row("J2", "2")])
    snapshot_stream(spark, landing, f"{tmpdir_path}/root", f"{tmpdir_path}/ckpt").awaitTermination(300)
    life = {r["job_number"]: r for r in history.read_lifecycle(spark, f"{tmpdir_path}/root").collect()}
    assert life["J2"]["run_id"] == 20260812001


def test_streaming_checks_headers_and_rows(spark, tmpdir_path):
    landing, root = f"{tmpdir_path}/landing", f"{tmpdir_path}/root"
    os.makedirs(landing)
    _csv(f"{landing}/a_2026-08-10.csv", [_row("J1", "3")])
    turned = OPEN_ORDER_HEADERS[::-1]
    with open(f"{landing}/b_2026-08-10.csv", "w") as fh:  # another order, one more column, and rows of other lengths
        fh.write(",".join([*turned, "Note"]) + "\n" + ",".join([*_row("J2", "4")[::-1], "x"]) + "\n")
        fh.write("only,three,fields\n" + ",".join([*_row("J3", "4")[::-1], "x", "y"]) + "\n")
    with open(f"{landing}/c_2026-08-10.csv", "w") as fh:
        fh.write("Due Date,Job Number\n2026-08-04,J9\n")
    _csv(f"{landing}/d_2026-08-10.csv", [])
    snapshot_stream(spark, landing, root, f"{tmpdir_path}/ckpt", database="streamed").awaitTermination(300)
    runs = {r["run_id"]: (r["source_name"].rsplit("/", 1)[1], r["row_count"], str(r["run_date"])) for r in read(spark, root, "scheduler_run").collect()}
    assert runs == {20260810001: ("a_2026-08-10.csv", 1, "2026-08-10"), 20260810002: ("b_2026-08-10.csv", 1, "2026-08-10")}
    rows = {r["job_number"]: r for r in read(spark, root, "order_snapshot").collect()}
    assert set(rows) == {"J1", "J2"} and rows["J2"]["molds_completed"] == 4 and rows["J2"]["pour_weight"] == rows["J1"]["pour_weight"]
    bad = {r["file"].rsplit("/", 1)[1]: r["reason"] for r in read(spark, root, "quarantine_files").collect()}
    assert set(bad) == {"c_2026-08-10.csv", "d_2026-08-10.csv"} and bad["c_2026-08-10.csv"].startswith("missing columns: Customer Name")
    assert bad["d_2026-08-10.csv"] == "no rows"
    lines = [r["line"] for r in read(spark, root, "quarantine_rows").collect()]
    assert len(lines) == 2 and "only,three,fields" in lines
    # a later file of the same day is a run of its own; a replayed file replaces its run
    _csv(f"{landing}/a_late_2026-08-10.csv", [_row("J1", "5")])
    snapshot_stream(spark, landing, root, f"{tmpdir_path}/ckpt").awaitTermination(300)
    life = {r["job_number"]: r for r in history.read_lifecycle(spark, root).collect()}
    assert life["J1"]["run_id"] == 20260810003 and life["J1"]["runs_seen"] == 2 and life["J2"]["runs_seen"] == 1
    ingest(spark, root, [f"file://{landing}/a_late_2026-08-10.csv"])
    assert sorted(r["run_id"] for r in read(spark, root, "scheduler_run").collect()) == [20260810001, 20260810002, 20260810003]
    assert {r["job_number"]: r for r in history.read_lifecycle(spark, root).collect()} == life
    assert spark.table("streamed.order_snapshot").count() == 2


def test_report_file_is_typed_and_scheduled(spark, tmpdir_path):
    from castplan.operators import capacity, eligibility
    from castplan.plans.schedule import load_scheduler_input
    path = f"{tmpdir_path}/report.csv"
    with open(path, "w") as fh:
        fh.write("Due Date,Job Number,Casting Type,Pour Weight,Molds Needed,Hold,Alloy,Job Type,Quantity of Molds\n"
                 "2026-08-20,J1,L,12.5,7,NO,A,JOB,9\n,J2,F,\"$1,000.25\",2.5,NO,A,JOB,\nsoon,J3,L,n/a,1,NO,,JOB,x\n2026-08-21,J4,L,5,3,YES,A,JOB,3\n")
    inp = load_scheduler_input(spark, "report", report_path=path)
    rows = eligibility.schedule_rows(eligibility.eligible(inp))
    out = capacity.mold_assignments(rows, dt.date(2026, 8, 10)).collect()
    got = sorted((r["job_number"], r["schedule_day"], r["molds_for_ext"], r["total_weight_per_ext"], r["pool"]) for r in out)
    assert got == [("J1", 1, 6, 75, 0), ("J1", 2, 1, 12, 0), ("J2", 1, 3, 3000, 0), ("J3", 1, 1, 0, 0)]
