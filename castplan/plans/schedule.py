"""End-to-end schedule: ERP views -> open orders -> eligible schedule rows -> assignments.

``build_schedule`` returns lazily-built DataFrames; the assignments (the fan-out point for
about ten reports) are cut from their lineage with ``checkpoint()`` when ``materialize`` is
set, which also pins the grouped-map output so a lost executor does not re-run allocation
with different inputs.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from castplan.functions.dates import reference_date_or_today
from castplan.operators import capacity, compat, eligibility, open_orders as oo, quality
from castplan.operators.ordinal import sorted_ordinal
from castplan.session import store
from castplan.schemas import DEFAULT_HOUSE_ACCOUNTS, CapacityLimits
from castplan.sources.adapter import compat_reference, erp_views

REFERENCE_DATE = _dt.date(2001, 6, 1)   # fixed "today" for the 1995-2001 driver data
START_DATE = _dt.date(2001, 6, 2)       # first production day candidate (tomorrow)


@dataclass
class ScheduleParams:
    reference_date: _dt.date | None = None  # today
    start_date: _dt.date | None = None  # the day after the reference date
    limits: CapacityLimits = field(default_factory=CapacityLimits)
    pool_cols: tuple = ("pool",)
    house_accounts: tuple = DEFAULT_HOUSE_ACCOUNTS
    honor_hold: bool = True
    validate: bool = False
    materialize: bool = False

    def __post_init__(self):
        self.reference_date = reference_date_or_today(self.reference_date)
        self.start_date = self.start_date or self.reference_date + _dt.timedelta(days=1)


@dataclass
class Schedule:
    open_orders: DataFrame
    scheduler_input: DataFrame
    schedule_rows: DataFrame
    assignments: DataFrame
    params: ScheduleParams


def scheduler_input(spark: SparkSession, sf_dir: str, p: ScheduleParams, orders: DataFrame | None = None):
    """(scheduler input, open orders after exclusion) for the driver tables."""
    if orders is None:
        orders = oo.open_orders(erp_views(spark, sf_dir))
    orders = quality.exclude_customers(orders, p.house_accounts)
    if p.validate:
        orders = quality.validate_rows(orders)
    cmap = compat.compat_map(compat_reference(spark))
    return compat.attach_compat(eligibility.scheduler_input(orders, p.honor_hold), cmap), orders


def build_schedule(spark: SparkSession, sf_dir: str, p: ScheduleParams | None = None,
                   open_orders: DataFrame | None = None) -> Schedule:
    """``open_orders`` may be passed in already materialised (shared with other reports)."""
    p = p or ScheduleParams()
    if p.materialize:
        if open_orders is None:
            # open orders are the expensive scan-join-aggregate; pin them once, reliably
            open_orders = store(oo.open_orders(erp_views(spark, sf_dir)), "open-orders")
    inp, orders = scheduler_input(spark, sf_dir, p, open_orders)
    rows = sorted_ordinal(eligibility.schedule_rows(eligibility.eligible(inp)), ["due_date", "job_number"])
    if p.materialize:
        rows = store(rows, "schedule-rows")
    asg = capacity.mold_assignments(rows, p.reference_date, p.limits, p.pool_cols)
    if p.materialize:
        asg = store(asg, "assignments")
    return Schedule(orders, inp, rows, asg, p)


def load_scheduler_input(spark: SparkSession, source: str, sf_dir: str | None = None,
                         report_path: str | None = None, report_format: str = "csv",
                         p: ScheduleParams | None = None, compat_table: DataFrame | None = None) -> DataFrame:
    """Scheduler input from ``source``: ``"sql"`` assembles it from the ERP views (house
    accounts removed, remaining molds derived); ``"report"`` reads an open-order report
    extract and trusts its Molds Needed / Hold / Scheduled columns.  Anything else raises."""
    from castplan.sources.files import read_open_order_report
    p = p or ScheduleParams()
    cmap = compat.compat_map(compat_table if compat_table is not None else compat_reference(spark))
    if source == "sql":
        return scheduler_input(spark, sf_dir, p)[0] if compat_table is None else compat.attach_compat(
            eligibility.scheduler_input(quality.exclude_customers(
                oo.open_orders(erp_views(spark, sf_dir)), p.house_accounts), p.honor_hold), cmap)
    if source in ("report", "excel"):
        return compat.attach_compat(read_open_order_report(spark, report_path, report_format), cmap)
    raise RuntimeError(f"Unsupported scheduler input source '{source}'. Use 'sql' or 'report'.")
