"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castplan.functions.clean import normalize_alloy_list, text_to_decimal, canonical_number_text
from castplan.functions.dates import add_business_days, decode_erp_date
from castplan.operators import capacity, compat, eligibility, quality
from castplan.operators import heats
from castplan.operators import open_orders as oo
from castplan.operators import priority, reporting
from castplan.operators.calendar import business_calendar
from castplan.operators.open_orders import dashboard_history
from castplan.operators.ordinal import sorted_ordinal
from castplan.plans import heat_reports, melt_reports, publication
from castplan.plans import mold_reports, shipping
from castplan.plans.outputs import canonical
from castplan.plans.schedule import REFERENCE_DATE, START_DATE, ScheduleParams, build_schedule, load_scheduler_input
from castplan.schemas import HEADER_TO_COLUMN, OPEN_ORDER_HEADERS
from castplan.session import drop_folder, ensure_checkpoint_dir, release_shuffles, steps, store
from castplan.sources import catalog, history
from castplan.sources.files import load_compat_table, read_snapshot_csv
from castplan.sources.loads import read
from castplan.sources.adapter import compat_reference
from castplan.sources.adapter import order_snapshot, read_table, scheduler_run
from castplan.sources.adapter import erp_views

QUERIES = {}


def register(name):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return canonical(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


P = ScheduleParams(reference_date=REFERENCE_DATE, start_date=START_DATE, materialize=True)
_MEMO: dict = {}


def memo(spark, sf_dir, key, build):
    """Per-session memo of shared intermediate plans (and their checkpoints), so that the
    reports of one run fan out from one computed schedule instead of recomputing it.  A table of
    the folder that is written anew (another size or time) makes a new run."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    stamp = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    k = (spark.sparkContext.applicationId, sf_dir, stamp, key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def run_erp(spark, sf_dir):
    """ERP views of the run with the order lines (detail x header, the largest join)
    written once to the shared checkpoint folder and read back by every report."""
    def build():
        root = ensure_checkpoint_dir(spark)
        tag = abs(hash(sf_dir)) % 10**8
        path = f"{root}/castplan-{spark.sparkContext.applicationId}/order_lines_{tag}"
        return oo.materialize_order_lines(erp_views(spark, sf_dir), path)
    return memo(spark, sf_dir, "erp", build)


def assembled_orders(spark, sf_dir):
    """Open-order rows before the completeness filter, computed once and checkpointed
    (the validation audit reads them unfiltered, everything else filtered).  They read the order lines
    once and few of their fields, which costs less than the run's written lines."""
    def build():
        with steps(spark) as keep:
            return store(oo.open_orders(erp_views(spark, sf_dir), complete_only=False, keep=keep), "assembled-orders")
    return memo(spark, sf_dir, "assembled_orders", build)


def shared_orders(spark, sf_dir):
    """Open orders of the run (completeness filter over the shared checkpoint)."""
    return oo.complete_rows(assembled_orders(spark, sf_dir))


def schedule(spark, sf_dir):
    """The run's schedule (open orders -> schedule rows -> assignments), built once."""
    return memo(spark, sf_dir, "schedule",
                lambda: build_schedule(spark, sf_dir, P, shared_orders(spark, sf_dir)))


# =============================================================================================
# Registered queries
# =============================================================================================
@register("open_orders")
def q_open_orders(spark, sf_dir):
    """Live open-order report assembled from the ERP views."""
    return shared_orders(spark, sf_dir)


@register("scheduler_input")
def q_scheduler_input(spark, sf_dir):
    """House accounts removed, remaining molds, hold/scheduled flags, compatibility attached."""
    return schedule(spark, sf_dir).scheduler_input


@register("reject_counts")
def q_reject_counts(spark, sf_dir):
    """Eligibility rule outcome counts per reason (added = eligible)."""
    return eligibility.reject_counts(schedule(spark, sf_dir).scheduler_input)


@register("schedule_rows")
def q_schedule_rows(spark, sf_dir):
    """Eligible jobs expanded to schedule rows (ceil'd molds, weight, blank extension)."""
    return schedule(spark, sf_dir).schedule_rows


@register("mold_assignments")
def q_mold_assignments(spark, sf_dir):
    """Capacity-limited day allocation of every schedule row, per capacity pool."""
    s = schedule(spark, sf_dir)
    return s.assignments.select("pool", "job_number", "schedule_day", "molds_for_ext",
                                "total_weight_per_ext", "pour_schedule_day", "casting_type",
                                "compatibility_group", "due_date")


@register("capacity_check")
def q_capacity_check(spark, sf_dir):
    """Per pool: planned vs assigned molds and days breaking any daily cap (must be 0)."""
    s = schedule(spark, sf_dir)
    return capacity.capacity_check(s.assignments, s.schedule_rows, P.limits, P.pool_cols)


@register("floor_lane_schedule")
def q_floor_lane(spark, sf_dir):
    """Closed-form (pure SQL) day allocation of the floor lane of each pool."""
    s = schedule(spark, sf_dir)
    return capacity.floor_lane_closed_form(s.schedule_rows, P.reference_date, P.limits, P.pool_cols)


@register("business_calendar")
def q_calendar(spark, sf_dir):
    """Weekday calendar for schedule days 1..last mold day."""
    s = schedule(spark, sf_dir)
    return business_calendar(s.assignments, P.start_date, "schedule_day")


@register("daily_mold_schedule")
def q_daily_mold_schedule(spark, sf_dir):
    """Day blocks: chunk rows with pour date, buffer and risk, plus a totals row per day."""
    return mold_reports.daily_mold_schedule(schedule(spark, sf_dir).assignments, P.start_date)


@register("mold_rows")
def q_mold_rows(spark, sf_dir):
    """Flat mold rows: every chunk once, with dates, buffer and risk."""
    return mold_reports.mold_rows(schedule(spark, sf_dir).assignments, P.start_date)


@register("mold_assignments_hot_pool")
def q_mold_assignments_hot_pool(spark, sf_dir):
    """Allocation where half of all plants are one pool: it is filled in blocks of days."""
    rows = schedule(spark, sf_dir).schedule_rows.withColumn("pool", F.when(F.col("pool") % 2 == 0, 0).otherwise(F.col("pool")))
    out = capacity.mold_assignments(rows, P.reference_date, P.limits, P.pool_cols)
    return out.select("pool", "job_number", "schedule_day", "molds_for_ext", "total_weight_per_ext")


def _repeated_rows(spark, sf_dir, keep_part=False):
    """Schedule rows split in two, three or four rows of equal job and extension."""
    rows = schedule(spark, sf_dir).schedule_rows.drop("row_seq")
    parts = F.least(F.col("molds_for_ext"), (F.col("molds_for_ext") % 3 + 2))
    split = rows.withColumn("_n", parts).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    share = F.floor(F.col("molds_for_ext") / F.col("_n")) + F.when(F.col("_i") <= F.col("molds_for_ext") % F.col("_n"), 1).otherwise(0)
    split = split.withColumn("molds_for_ext", share.cast("int"))
    return split.withColumnsRenamed({"_n": "parts", "_i": "part_no"}) if keep_part else split.drop("_n", "_i")


def _repeated_assignments(spark, sf_dir):
    return memo(spark, sf_dir, "repeated_assignments", lambda: store(capacity.mold_assignments(
        _repeated_rows(spark, sf_dir), P.reference_date, P.limits, P.pool_cols), "repeated-assignments"))


@register("mold_assignments_repeated_jobs")
def q_mold_assignments_repeated(spark, sf_dir):
    """Allocation where every job has several rows with equal extension in its pool."""
    out = _repeated_assignments(spark, sf_dir)
    return out.select("pool", "job_number", "planned_molds_for_ext", "schedule_day", "molds_for_ext", "total_weight_per_ext")


@register("capacity_check_repeated_jobs")
def q_capacity_check_repeated(spark, sf_dir):
    """Planned and assigned molds and broken caps per pool, for jobs of several rows."""
    return capacity.capacity_check(_repeated_assignments(spark, sf_dir), _repeated_rows(spark, sf_dir), P.limits, P.pool_cols)


@register("mold_schedule_sheet")
def q_mold_schedule_sheet(spark, sf_dir):
    """Mold schedule sheet columns with totals rows and average molds per day."""
    return mold_reports.mold_schedule_sheet(schedule(spark, sf_dir).assignments, P.start_date)


@register("mold_capacity")
def q_mold_capacity(spark, sf_dir):
    """Line/floor mold use per pool and day against the daily limits."""
    return mold_reports.mold_capacity(schedule(spark, sf_dir).assignments, P.limits)


@register("day_summary")
def q_day_summary(spark, sf_dir):
    """Per pool and day: distinct jobs, molds and rounded row weight."""
    return mold_reports.day_summary(schedule(spark, sf_dir).assignments)


@register("report_averages")
def q_report_averages(spark, sf_dir):
    """Average molds per day and poured pounds per day, per pool."""
    return mold_reports.report_averages(schedule(spark, sf_dir).assignments)


@register("job_shipping_outlook")
def q_job_shipping_outlook(spark, sf_dir):
    """Per job: planned vs scheduled molds, dates, expected ship, buffer, status, on-time."""
    s = schedule(spark, sf_dir)
    return shipping.job_shipping_outlook(s.schedule_rows, s.assignments, P.start_date)


@register("job_status")
def q_job_status(spark, sf_dir):
    """Overall job status (projection of the shipping outlook)."""
    s = schedule(spark, sf_dir)
    return shipping.job_status(shipping.job_shipping_outlook(s.schedule_rows, s.assignments, P.start_date))


def _plan(spark, sf_dir):
    return memo(spark, sf_dir, "melt_plan", lambda: store(heats.melt_plan(
        schedule(spark, sf_dir).assignments, P.reference_date), "melt-plan"))


def _summary(spark, sf_dir):
    return memo(spark, sf_dir, "heat_summary", lambda: store(heat_reports.heat_summary_rows(
        _plan(spark, sf_dir), P.start_date, P.reference_date), "heat-summary"))


@register("melt_plan")
def q_melt_plan(spark, sf_dir):
    """Pour days and heat numbers of every assignment chunk (our documented producer)."""
    return _plan(spark, sf_dir).select(
        "pool", "job_number", "schedule_day", "original_pour_schedule_day", "pour_schedule_day",
        "heat_number", "global_heat_number", "heat_status", "planning_priority", "review_window",
        "days_until_due", "molds_for_ext", "total_weight_per_ext")


@register("heat_summary")
def q_heat_summary(spark, sf_dir):
    """Heat summary rows: status, due window, weight, molds, lead days, two-week rule."""
    return _summary(spark, sf_dir)


@register("heat_planner")
def q_heat_planner(spark, sf_dir):
    """Heat planner sheet rows with blank manual-entry columns and status bands."""
    return heat_reports.heat_planner_rows(_summary(spark, sf_dir))


@register("heat_daily_totals")
def q_heat_daily_totals(spark, sf_dir):
    """Per pool and date: heats, planned/overflow/at-risk counts, weight and molds."""
    return heat_reports.heat_daily_totals(_summary(spark, sf_dir))


@register("heat_detail")
def q_heat_detail(spark, sf_dir):
    """Row-level heat plan with due buffer."""
    return heat_reports.heat_detail_rows(_plan(spark, sf_dir), P.start_date)


@register("heat_sheet")
def q_heat_sheet(spark, sf_dir):
    """Heat schedule sheet with per-day totals rows and average poured pounds per day."""
    return heat_reports.heat_sheet(_summary(spark, sf_dir))


@register("melt_management")
def q_melt_management(spark, sf_dir):
    """Melt management summary per heat: customers, jobs, date ranges, ship date, status."""
    plan = _plan(spark, sf_dir)
    return melt_reports.melt_management(_summary(spark, sf_dir), plan, P.start_date)


@register("melt_capacity")
def q_melt_capacity(spark, sf_dir):
    """Daily melt capacity: heats and pounds per pour day against the targets."""
    return melt_reports.melt_capacity(_plan(spark, sf_dir), P.limits)


@register("melt_schedule")
def q_melt_schedule(spark, sf_dir):
    """Melt department schedule rows with molds on floor (gaps-and-islands running sum)."""
    return melt_reports.melt_schedule(_plan(spark, sf_dir), P.start_date)


@register("melt_gap_diagnostics")
def q_melt_gap_diagnostics(spark, sf_dir):
    """Skipped pour days with mold-window capacity use, heat moves and likely cause."""
    return melt_reports.melt_gap_diagnostics(_plan(spark, sf_dir), P.start_date, P.limits)


@register("validation_summary")
def q_validation_summary(spark, sf_dir):
    """Required-column blank counts and sample jobs over the assembled (unfiltered) rows."""
    return quality.validation_summary(assembled_orders(spark, sf_dir))


@register("missing_job_audit")
def q_missing_job_audit(spark, sf_dir):
    """Order lines without a job key: total count and the first ten by order and line."""
    return quality.missing_job_audit(run_erp(spark, sf_dir))


@register("audit_by_month")
def q_audit_by_month(spark, sf_dir):
    """Missing-job audit per month, newest twelve months kept (retention)."""
    return quality.audit_by_month(run_erp(spark, sf_dir))


@register("open_order_report")
def q_open_order_report(spark, sf_dir):
    """Open-order report rendered as text with canonical numbers and the Scheduled flag."""
    s = schedule(spark, sf_dir)
    return reporting.open_order_report(s.open_orders, s.assignments)


@register("dashboard_history")
def q_dashboard_history(spark, sf_dir):
    """History dashboard for the latest snapshot run, with per-job order roll-ups."""
    return dashboard_history(run_erp(spark, sf_dir), order_snapshot(spark, sf_dir),
                             scheduler_run(spark, sf_dir))


@register("dashboard_history_window")
def q_dashboard_history_window(spark, sf_dir):
    """History dashboard for run 2 restricted to due dates in the second quarter of 2001."""
    return dashboard_history(run_erp(spark, sf_dir), order_snapshot(spark, sf_dir),
                             scheduler_run(spark, sf_dir), run_id=2,
                             start_due_date="2001-04-01", end_due_date="2001-06-30")


@register("due_date_decode")
def q_due_date_decode(spark, sf_dir):
    """Mixed-encoding required dates of every order line decoded (detail, then header)."""
    erp = run_erp(spark, sf_dir)
    lines = oo.order_lines(erp)
    dd = decode_erp_date(F.col("d.required_date"))
    hd = decode_erp_date(F.col("h.required_date"))
    return lines.select(F.col("d.order_number").alias("order_number"),
                        F.col("d.line_number").alias("line_number"),
                        F.col("d.required_date").alias("detail_text"),
                        F.col("h.required_date").alias("header_text"),
                        dd.alias("detail_date"), hd.alias("header_date"),
                        F.coalesce(dd, hd).alias("due_date"))


@register("business_day_add")
def q_business_day_add(spark, sf_dir):
    """Order date shifted by (orderkey % 21 - 10) business days, weekends skipped."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    n = (F.col("o_orderkey") % 21 - 10).cast("int")
    return o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"),
                    n.alias("offset_days"),
                    add_business_days(F.col("o_orderdate").cast("date"), n).alias("shifted_date"))


@register("alloy_list_normalize")
def q_alloy_list_normalize(spark, sf_dir):
    """Comma lists built from part attributes: trimmed, upper-cased, deduplicated in order."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    raw = F.concat_ws(",", F.lower("p_type"), F.lit(" "), F.col("p_type"), F.col("p_brand"),
                      F.concat(F.lit(" "), F.lower("p_brand")))
    return p.select("p_partkey", raw.alias("raw_list"), normalize_alloy_list(raw).alias("normalized"))


@register("number_text")
def q_number_text(spark, sf_dir):
    """ERP number text (with $ and thousands commas) parsed to decimals and canonical text."""
    erp = erp_views(spark, sf_dir)
    jm = erp.job_master
    return jm.select("job_number", "pour_weight_text",
                     text_to_decimal("pour_weight_text").alias("pour_weight"),
                     canonical_number_text("pour_weight_text").alias("canonical_text"),
                     text_to_decimal("tool_impressions").alias("castings_per_mold"))


@register("planning_priority")
def q_planning_priority(spark, sf_dir):
    """Schedule rows classified into priority windows and ranked per pool."""
    s = schedule(spark, sf_dir)
    return priority.prioritize(s.schedule_rows, P.reference_date).select(
        "pool", "job_number", "due_date", "planning_priority_rank", "planning_priority",
        "review_window", "days_until_due", "planning_seq")


@register("co_pour_candidates")
def q_co_pour_candidates(spark, sf_dir):
    """For each alloy on open orders, the alloys on open orders it may share a heat with."""
    inp = schedule(spark, sf_dir).scheduler_input
    return compat.co_pour_candidates(inp, compat.compat_map(compat_reference(spark)))


def export_text(df):
    """Open-order rows as the ERP export would carry them: every column as text under its
    report header (dates yyyy-MM-dd, NULL stays NULL)."""
    cols = []
    for h in OPEN_ORDER_HEADERS:
        c = HEADER_TO_COLUMN[h]
        v = F.date_format(c, "yyyy-MM-dd") if c == "due_date" else F.col(c).cast("string")
        cols.append(v.alias(h))
    return df.select(*cols)


@register("snapshot_raw")
def q_snapshot_raw(spark, sf_dir):
    """Open-order export rows stored as raw trimmed text under run 1."""
    return history.raw_snapshot_rows(export_text(shared_orders(spark, sf_dir)), 1)


@register("snapshot_typed")
def q_snapshot_typed(spark, sf_dir):
    """Raw text snapshot rows converted back to typed columns."""
    return history.transform_raw_snapshot(
        history.raw_snapshot_rows(export_text(shared_orders(spark, sf_dir)), 1))


@register("order_lifecycle")
def q_order_lifecycle(spark, sf_dir):
    """Per job over all snapshot runs: latest values, first/last run seen, runs seen."""
    snap = order_snapshot(spark, sf_dir).withColumn("job_number", F.upper(F.trim("job_number")))
    return history.upsert_lifecycle(None, snap).drop("run_ids")


@register("order_lifecycle_incremental")
def q_order_lifecycle_incremental(spark, sf_dir):
    """The lifecycle folded run by run into a history folder, run 2 loaded twice."""
    snap = order_snapshot(spark, sf_dir).withColumn("job_number", F.upper(F.trim("job_number")))
    root = f"{ensure_checkpoint_dir(spark)}/castplan-{spark.sparkContext.applicationId}/history-{uuid.uuid4().hex[:8]}"
    for run in (1, 2, 3, 2):
        history.fold_typed(spark, snap.where(F.col("run_id") == run), root, [run])
    return history.read_lifecycle(spark, root).drop("run_ids")


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/castplan-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"


def _loaded_history(spark, sf_dir):
    """(root, database) of a history of three loads of the open orders' CSV export: run 1 of all jobs, run 2 of every
    other due day, run 3 raw only, then run 1 again without jobs that are due on odd days."""
    def build():
        root, database = _scratch(spark, "history"), f"history_{uuid.uuid4().hex[:8]}"
        rows = export_text(shared_orders(spark, sf_dir))
        even = F.dayofmonth(F.col("`Due Date`").cast("date")) % 2 == 0
        for run_id, part, raw_only in ((1, rows, False), (2, rows.where(even), False), (3, rows, True), (1, rows.where(even), False)):
            path = _scratch(spark, "export")
            part.write.option("header", True).csv(path)
            history.load_snapshot(spark, read_snapshot_csv(spark, path), root, f"2001-06-0{run_id}", f"export-{run_id}", run_id, raw_only, database)
            drop_folder(spark, path)  # the load has its rows
            release_shuffles(spark)
        return root, database
    return memo(spark, sf_dir, "loaded_history", build)


@register("history_runs")
def q_history_runs(spark, sf_dir):
    """The run registry after four loads of CSV exports, one of them a repeated run."""
    return read(spark, _loaded_history(spark, sf_dir)[0], "scheduler_run")


@register("history_raw_rows")
def q_history_raw_rows(spark, sf_dir):
    """Raw rows per run after the loads, one of them without typed rows."""
    root = _loaded_history(spark, sf_dir)[0]
    raw = read(spark, root, "order_snapshot_raw").groupBy("run_id").agg(F.count(F.lit(1)).alias("raw_rows"))
    typed = read(spark, root, "order_snapshot").groupBy("run_id").agg(F.count(F.lit(1)).alias("typed_rows"))
    return raw.join(typed, "run_id", "left").fillna(0, ["typed_rows"])


@register("history_lifecycle")
def q_history_lifecycle(spark, sf_dir):
    """Runs in which each job was seen, after a run was loaded again with fewer jobs."""
    return history.read_lifecycle(spark, _loaded_history(spark, sf_dir)[0]).select("job_number", "first_seen_run", "last_seen_run", "runs_seen", "molds_completed")


@register("dashboard_from_catalog")
def q_dashboard_from_catalog(spark, sf_dir):
    """The dashboard of run 2, its source chosen by the catalog that the loads registered.  The order lines are read once and few
    of their fields, which takes less disk than the run's written lines."""
    erp, database = erp_views(spark, sf_dir), _loaded_history(spark, sf_dir)[1]

    def build():
        with steps(spark) as keep:
            return store(oo.orders_by_job_history(erp, keep), "history-by-job")
    kind, rows = oo.dashboard_rows(spark, erp, database, run_id=2, orders=memo(spark, sf_dir, "history_by_job", build))
    return rows.withColumn("source", F.lit(kind))


@register("history_tables")
def q_history_tables(spark, sf_dir):
    """The history tables and the number of their columns, as the catalog lists them."""
    database = _loaded_history(spark, sf_dir)[1]
    tables = [r["name"] for r in catalog.list_tables(spark, database).collect()]
    columns = reduce(DataFrame.unionByName, [catalog.list_columns(spark, t, database) for t in tables])
    return columns.where("name <> 'load'").groupBy(F.col("table").alias("table_name")).agg(F.count(F.lit(1)).alias("n_columns"))


@register("text_snapshot")
def q_text_snapshot(spark, sf_dir):
    """Schedule rows saved as a dated text snapshot and read back."""
    path = _scratch(spark, "text")
    rows = schedule(spark, sf_dir).schedule_rows.select("pool", "job_number", "due_date", "alloy", "molds_for_ext", "heat_no_assigned")
    history.save_text_snapshot(rows, path, "2001-06-01_080000")
    return spark.read.schema(", ".join(f"{c} string" for c in [*rows.columns, "snapshot_ts"])).parquet(path)


@register("archived_reports")
def q_archived_reports(spark, sf_dir):
    """The job status archived twice on one day and once on the next: rows by day and number."""
    path, status = _scratch(spark, "archive"), q_job_status(spark, sf_dir)
    for day, part in (("2001-06-01", status), ("2001-06-01", status.where("on_time = 'YES'")), ("2001-06-02", status)):
        history.archive_report(spark, part, path, day)
    kept = spark.read.parquet(path)
    return kept.groupBy(F.col("as_of_date").cast("date").alias("as_of_date"), F.col("seq").cast("long").alias("seq")).agg(F.count(F.lit(1)).alias("row_count"))


@register("compat_table_file")
def q_compat_table_file(spark, sf_dir):
    """Alloys of the schedule with their groups, from the compatibility reference read back from a CSV file."""
    path = _scratch(spark, "compat")
    compat_reference(spark).orderBy("file_line").drop("file_line").coalesce(1).write.option("header", True).csv(path)
    cmap = compat.compat_map(load_compat_table(spark, path))
    alloys = schedule(spark, sf_dir).scheduler_input.select("alloy").distinct()
    return compat.attach_compat(alloys, cmap).select("alloy", "compatibility_group", "compat_all", "specific_alloys")


def _published(spark, sf_dir):
    """The published sheets, read back from their folders."""
    def build():
        root = f"{ensure_checkpoint_dir(spark)}/castplan-{spark.sparkContext.applicationId}/sheets-{uuid.uuid4().hex[:8]}"
        s = schedule(spark, sf_dir)
        six = publication.six_sheets(s, _plan(spark, sf_dir), _summary(spark, sf_dir))
        return six.keys(), publication.read_sheets(spark, publication.publish_sheets({**six, **publication.day_sheets(s)}, root))
    return memo(spark, sf_dir, "published", build)


@register("published_sheets")
def q_published_sheets(spark, sf_dir):
    """The six sheets published to a folder and read back: rows per sheet."""
    six, sheets = _published(spark, sf_dir)
    counts = [sheets[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("sheet"), "row_count") for name in six]
    return reduce(DataFrame.unionByName, counts)


def _register_sheet(sheet: str):
    @register("published_" + sheet.lower().replace(" ", "_"))
    def q_sheet(spark, sf_dir):
        return _published(spark, sf_dir)[1][sheet]
    q_sheet.__doc__ = f"The published sheet {sheet}, read back with every row's position in the files."


for _sheet in ("Overall Summary", "Melt Schedule", "Melt Diagnostics", "Mold Schedule", "Melt Summary", "Mold Summary", "Open Orders", "Daily Mold Schedule"):
    _register_sheet(_sheet)


#: Slots of every pour day that are set aside in the queries of reserved slots.
RESERVED = (2, 6)


def _reserved(spark, sf_dir):
    """(plan, summary) with slots set aside on every pour day."""
    def build():
        plan = store(heats.melt_plan(schedule(spark, sf_dir).assignments, P.reference_date, reserved=RESERVED), "reserved-plan")
        return plan, store(heat_reports.heat_summary_rows(plan, P.start_date, P.reference_date, RESERVED), "reserved-summary")
    return memo(spark, sf_dir, "reserved", build)


@register("heat_planner_reserved")
def q_heat_planner_reserved(spark, sf_dir):
    """Planner sheet with reserved slots: blank rows to be filled by hand, heats numbered around them."""
    return heat_reports.heat_planner_rows(_reserved(spark, sf_dir)[1])


@register("heat_daily_totals_reserved")
def q_heat_daily_totals_reserved(spark, sf_dir):
    """Daily heat totals of a plan with reserved slots, which don't count."""
    return heat_reports.heat_daily_totals(_reserved(spark, sf_dir)[1])


@register("heat_sheet_reserved")
def q_heat_sheet_reserved(spark, sf_dir):
    """Heat sheet with its reserved slots as rows."""
    return heat_reports.heat_sheet(_reserved(spark, sf_dir)[1])


@register("melt_management_reserved")
def q_melt_management_reserved(spark, sf_dir):
    """Melt management of a plan with reserved slots, which are left out."""
    plan, summary = _reserved(spark, sf_dir)
    return melt_reports.melt_management(summary, plan, P.start_date)


@register("heat_compat_audit")
def q_heat_compat_audit(spark, sf_dir):
    """Per heat: rows whose alloy the heat's first alloy doesn't accept."""
    return compat.heat_compat_audit(_plan(spark, sf_dir))


@register("job_shipping_outlook_repeated_jobs")
def q_job_shipping_outlook_repeated(spark, sf_dir):
    """Shipping outlook of jobs of several rows: the customer is the first non-blank one in input order (the
    rows of a job come last part first; the last part has no customer)."""
    rows = _repeated_rows(spark, sf_dir, keep_part=True).drop("row_seq")
    names = F.when(F.col("part_no") == F.col("parts"), F.lit(" ")).otherwise(F.concat("customer_name", F.lit(" / "), F.col("part_no").cast("string")))
    rows = sorted_ordinal(rows.withColumn("customer_name", names), ["due_date", "job_number", F.col("part_no").desc()])
    asg = capacity.mold_assignments(rows, P.reference_date, P.limits, P.pool_cols)
    return shipping.job_shipping_outlook(rows, asg, P.start_date)


def _default_plan(spark, sf_dir):
    return memo(spark, sf_dir, "default_plan", lambda: store(heats.default_melt_plan(
        schedule(spark, sf_dir).assignments, P.reference_date), "default-plan"))


def _default_summary(spark, sf_dir):
    return heat_reports.heat_summary_rows(_default_plan(spark, sf_dir), P.start_date, P.reference_date)


@register("heat_summary_default")
def q_heat_summary_default(spark, sf_dir):
    """Heat summary where every chunk pours on its mold day in heat 1."""
    return _default_summary(spark, sf_dir)


@register("heat_daily_totals_default")
def q_heat_daily_totals_default(spark, sf_dir):
    """Daily heat totals of the default plan."""
    return heat_reports.heat_daily_totals(_default_summary(spark, sf_dir))


@register("melt_management_default")
def q_melt_management_default(spark, sf_dir):
    """Melt management summary of the default plan."""
    return melt_reports.melt_management(_default_summary(spark, sf_dir), _default_plan(spark, sf_dir), P.start_date)


@register("melt_capacity_default")
def q_melt_capacity_default(spark, sf_dir):
    """Daily melt capacity of the default plan."""
    return melt_reports.melt_capacity(_default_plan(spark, sf_dir), P.limits)


@register("report_schedule")
def q_report_schedule(spark, sf_dir):
    """The report-file run: the open-order sheet written as CSV text, read back, typed and
    scheduled; gives the assignments that the ERP run gives."""
    s = schedule(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/castplan-{spark.sparkContext.applicationId}/report-{uuid.uuid4().hex[:8]}"
    publish = reporting.report_sheet(s.scheduler_input)
    publish.write.option("header", True).csv(path)
    inp = load_scheduler_input(spark, "report", report_path=path, p=P)
    # the allocation reads its rows three times; unstored, each time would join the file's numbers to the wide rows
    rows = store(eligibility.schedule_rows(eligibility.eligible(inp)), "report-rows")
    out = capacity.mold_assignments(rows, P.reference_date, P.limits, P.pool_cols)
    return out.select("pool", "job_number", "schedule_day", "molds_for_ext",
                      "total_weight_per_ext", "pour_schedule_day", "casting_type",
                      "compatibility_group", "due_date")
