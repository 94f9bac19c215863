"""Open-order assembly from ERP tables (live) and the history dashboard.

Both are single lazy plans: pre-aggregate the order lines per job, then left-join the job
master, heat list and item master.  Catalyst turns the job-master left join into an inner
join because the completeness filter rejects rows without a customer, which exists only on
the job-master side.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castplan.functions.clean import blank_to_null, first_nonblank, hold_flag, norm_key, text_to_decimal, total_pour_fallback, zero_to_null
from castplan.functions.dates import decode_erp_date
from castplan.schemas import MIN_VALID_DUE_DATE
from castplan.sources.adapter import ErpViews


def order_job_key(detail_job: Column, header_job: Column) -> Column:
    """First non-blank job key (detail, then header), trimmed and upper-cased."""
    return norm_key(first_nonblank(detail_job, header_job))


def order_lines(erp: ErpViews) -> DataFrame:
    """Order detail joined to its header (inner, on order number); columns are addressed as
    ``d.<col>`` / ``h.<col>``.  Uses the run's materialised lines when present."""
    if erp.lines is not None:
        return erp.lines
    d = erp.oe_detail.alias("d")
    h = erp.oe_header.alias("h")
    return d.join(h, F.col("d.order_number") == F.col("h.order_number"), "inner")


def order_fields(erp: ErpViews, detail: dict, header: dict) -> DataFrame:
    """The order lines' fields ``{out: Column}`` of the detail (``d.<col>``) and of the header (``h.<col>``).  Lines that
    aren't materialised are joined by fields that are made before, so that no source text crosses the shuffle."""
    of_detail, of_header = ([c.alias(k) for k, c in fields.items()] for fields in (detail, header))
    if erp.lines is not None:
        return erp.lines.select(*of_detail, *of_header)
    d = erp.oe_detail.alias("d").select(F.col("d.order_number").alias("_d_order"), *of_detail)
    h = erp.oe_header.alias("h").select(F.col("h.order_number").alias("_h_order"), *of_header)
    return d.join(h, F.col("_d_order") == F.col("_h_order"), "inner").drop("_d_order", "_h_order")


def _as_is(rows: DataFrame, name: str) -> DataFrame:
    """The ``keep`` that stores nothing.  A ``keep(rows, name)`` that stores the rows of a step and reads them back ends the step's
    shuffles, so that those of the next aren't on disk beside them."""
    return rows


def open_orders_by_job(erp: ErpViews, keep=_as_is) -> DataFrame:
    """Open order lines aggregated per job: part, job type, decoded due date, qty, value."""
    lines = order_fields(erp, {
        "d_job": order_job_key(F.col("d.job_number"), F.lit(None)),
        "part": blank_to_null(F.col("d.product_number")),
        "job_type": blank_to_null(F.col("d.job_type")),
        "d_due": decode_erp_date(F.col("d.required_date")),
        "qty": F.col("d.quantity_ordered"),
        "value": F.col("d.extended_order_value"),
    }, {
        "h_job": order_job_key(F.col("h.job_number"), F.lit(None)),
        "h_due": decode_erp_date(F.col("h.required_date")),
    }).withColumns({"job_key": F.coalesce("d_job", "h_job"), "due": F.coalesce("d_due", "h_due")})
    lines = keep(lines.where(F.col("job_key").isNotNull()).drop("d_job", "h_job", "d_due", "h_due"), "open-lines")
    # lines are hashed to one row per (job, part, job type); only those few are left for the texts' maxima
    few = (lines.groupBy("job_key", "part", "job_type")
           .agg(F.max("due").alias("due"), F.sum(F.coalesce("qty", F.lit(0))).alias("qty"), F.sum(F.coalesce("value", F.lit(0))).alias("value")))
    return few.groupBy("job_key").agg(
        _greatest_text("part").alias("open_part"), _greatest_text("job_type").alias("open_job_type"), F.max("due").alias("open_due"),
        F.sum("qty").alias("open_qty"), F.sum("value").alias("open_value"))


def _greatest_text(c):
    """The maximum of a text column by hash aggregation (a plain maximum of texts sorts all rows)."""
    return F.array_max(F.collect_set(c))


def heat_list_by_job(erp: ErpViews, distinct: bool = False) -> DataFrame:
    """Comma list of the heats of each job, ordered by numeric value (non-numeric as 0), then
    text.  Repeated heat rows repeat in the list, as in the source; ``distinct=True`` keeps one
    of each, reduced map side before the shuffle."""
    h = (erp.jc_heat
         .select(norm_key("job_number").alias("job_key"),
                 blank_to_null("heat_number").alias("heat"))
         .where(blank_to_null("job_key").isNotNull() & F.col("heat").isNotNull()))
    h = h.distinct() if distinct else h
    return h.groupBy("job_key").agg(
        F.expr("listagg(heat, ', ') WITHIN GROUP "
               "(ORDER BY coalesce(try_cast(heat AS bigint), 0), heat)").alias("heat_list"))


def main_jobs(erp: ErpViews) -> DataFrame:
    """Active job-master rows with item-master alloy, typed and cleaned."""
    jm = erp.job_master.alias("jm")
    ic = erp.ic_master.alias("ic")
    j = jm.join(ic, F.col("ic.product_code") == F.col("jm.product_code"), "left")
    j = j.where(blank_to_null(F.col("jm.job_number")).isNotNull()
                & (F.col("jm.job_status_flag") == "I"))
    return j.select(
        norm_key(F.col("jm.job_number")).alias("job_key"),
        F.try_to_date(F.col("jm.due_date_text"), "yyyy-MM-dd").alias("due"),
        blank_to_null(F.col("jm.customer_name")).alias("customer_name"),
        blank_to_null(F.col("jm.product_code")).alias("part"),
        blank_to_null(F.col("jm.job_type")).alias("job_type"),
        blank_to_null(F.col("ic.base_material")).alias("alloy"),
        blank_to_null(F.col("jm.casting_type")).alias("casting_type"),
        blank_to_null(F.col("jm.heat_number")).alias("main_heat"),
        hold_flag(F.col("jm.job_on_hold")).alias("on_hold"),
        F.coalesce(F.col("jm.quantity_required"), F.lit(0)).alias("qty_castings"),
        text_to_decimal(F.col("jm.tool_impressions")).alias("castings_per_mold"),
        F.coalesce(F.col("jm.molds_required"), F.lit(0)).alias("qty_molds"),
        text_to_decimal(F.col("jm.cores_text")).alias("cores"),
        text_to_decimal(F.col("jm.pour_weight_text")).alias("pour_weight"),
        F.coalesce(F.col("jm.pour_quantity"), F.lit(0)).alias("total_pour"),
        F.coalesce(F.col("jm.contract_revised_amount"), F.col("jm.contract_original_amount"),
                   F.lit(0)).alias("total_value"),
        F.coalesce(F.col("jm.quantity_produced"), F.lit(0)).alias("castings_produced"),
        F.coalesce(F.col("jm.molds_produced"), F.lit(0)).alias("molds_completed"),
        F.col("jm.pool").alias("pool"),
    )


def _dec(c) -> Column:
    return c.cast("decimal(18,4)")


def open_orders(erp: ErpViews, keep_pool: bool = True, complete_only: bool = True, keep=_as_is) -> DataFrame:
    """Live open-order report: one row per job with due date, part, alloy, quantities.

    Output columns follow ``schemas.OPEN_ORDER_COLUMNS`` plus ``pool`` (capacity pool of
    the job; constant 0 when the job master has none).  ``complete_only=False`` skips the
    completeness filter (due date on/after 2000-01-01, customer, part and job present), which
    is what the required-column validation inspects.  ``keep`` may store the steps over all order lines
    (``_as_is``).
    """
    o = keep(open_orders_by_job(erp, keep), "orders-by-job").alias("o")
    m = main_jobs(erp).alias("m")
    h = keep(heat_list_by_job(erp), "heat-lists").alias("hl")
    ic_alt = erp.ic_master.select(F.col("product_code").alias("alt_code"),
                                  blank_to_null("base_material").alias("alt_alloy"))
    j = (o.join(m, F.col("o.job_key") == F.col("m.job_key"), "left")
         .join(h, F.col("hl.job_key") == F.col("o.job_key"), "left"))
    part = F.coalesce(F.col("m.part"), F.col("o.open_part"))
    j = j.withColumn("_part", part)
    j = j.join(ic_alt, ic_alt.alt_code == F.col("_part"), "left")
    weight = F.col("m.pour_weight")
    molds = F.col("m.qty_molds")
    total = F.col("m.total_pour")
    out = j.select(
        F.coalesce(F.col("m.due"), F.col("o.open_due")).alias("due_date"),
        F.col("m.customer_name").alias("customer_name"),
        F.col("_part").alias("part_number"),
        F.coalesce(F.col("m.job_type"), F.col("o.open_job_type")).alias("job_type"),
        F.col("o.job_key").alias("job_number"),
        F.coalesce(F.col("m.alloy"), F.col("alt_alloy")).alias("alloy"),
        F.col("m.casting_type").alias("casting_type"),
        _dec(F.coalesce(F.when(F.col("o.open_qty").isNull(), F.col("m.qty_castings"))
                        .otherwise(F.col("o.open_qty")), F.lit(0))).alias("qty_ordered"),
        _dec(F.coalesce(molds, F.lit(0))).alias("quantity_of_molds"),
        _dec(F.coalesce(F.col("m.castings_per_mold"), F.lit(0))).alias("castings_per_mold"),
        _dec(F.coalesce(F.col("m.cores"), F.lit(0))).alias("quantity_of_cores"),
        _dec(F.coalesce(weight, F.lit(0))).alias("pour_weight"),
        _dec(total_pour_fallback(total, weight, molds)).alias("total_pour_wt"),
        _dec(F.coalesce(F.col("o.open_value"), F.col("m.total_value"), F.lit(0))).alias("total_value"),
        F.coalesce(F.col("m.main_heat"), F.col("hl.heat_list"), F.lit("")).alias("heat_no_assigned"),
        _dec(zero_to_null("m.castings_produced")).alias("castings_produced"),
        _dec(zero_to_null("m.molds_completed")).alias("molds_completed"),
        F.coalesce(F.col("m.on_hold"), F.lit("NO")).alias("on_hold"),
        F.coalesce(F.col("m.pool"), F.lit(0)).alias("pool"),
    )
    if complete_only:
        out = complete_rows(out)
    return out if keep_pool else out.drop("pool")


def complete_rows(df: DataFrame) -> DataFrame:
    """Completeness filter: due date on/after the minimum, customer, part and job present."""
    return df.where(F.col("due_date").isNotNull()
                    & (F.col("due_date") >= F.lit(_dt.date.fromisoformat(MIN_VALID_DUE_DATE)))
                    & blank_to_null("customer_name").isNotNull()
                    & blank_to_null("part_number").isNotNull()
                    & blank_to_null("job_number").isNotNull())


def orders_by_job_history(erp: ErpViews, keep=_as_is) -> DataFrame:
    """Per-job order roll-up for the history dashboard: PO, ordered, shipped, ship date, value."""
    lines = order_fields(erp, {
        "d_job": order_job_key(F.col("d.job_number"), F.lit(None)),
        "qty": F.col("d.quantity_ordered"),
        "shipped": F.col("d.pieces_shipped_to_date"),
        "value": F.col("d.extended_order_value"),
    }, {
        "h_job": order_job_key(F.col("h.job_number"), F.lit(None)),
        "po": blank_to_null(F.col("h.customer_po")),
        "ship_date": F.col("h.ship_date"),
    }).withColumn("job_key", F.coalesce("d_job", "h_job"))
    lines = keep(lines.where(F.col("job_key").isNotNull()).drop("d_job", "h_job"), "history-lines")
    # nearly every line has a PO of its own, so lines go to their job at once; rows per (job, PO) would be as many and cross a shuffle more
    return lines.groupBy("job_key").agg(
        F.max("po").alias("customer_po"), F.sum(F.coalesce("qty", F.lit(0))).alias("quantity_ordered"),
        F.sum(F.coalesce("shipped", F.lit(0))).alias("quantity_shipped_to_date"), F.max("ship_date").alias("ship_date"),
        F.sum(F.coalesce("value", F.lit(0))).alias("total_value"))


def dashboard_history(erp: ErpViews, snapshot: DataFrame, runs: DataFrame, run_id=None,
                      start_due_date=None, end_due_date=None, orders: DataFrame | None = None) -> DataFrame:
    """History dashboard for one run (default: latest), optional inclusive due-date window.

    The target run is a scalar (max run id, or the one asked for) applied as a filter on
    ``run_id``, so partitioned snapshot tables are pruned to that one partition.  ``orders`` is the
    orders' roll-up (``orders_by_job_history``) if it was made before.
    """
    if run_id is None:
        target = runs.agg(F.max("run_id")).scalar()   # scalar subquery, evaluated once
    else:
        target = F.lit(int(run_id)).cast("long")
    s = snapshot.where(F.col("run_id") == target)
    if start_due_date is not None:
        s = s.where(F.col("due_date") >= F.lit(_dt.date.fromisoformat(str(start_due_date))))
    if end_due_date is not None:
        s = s.where(F.col("due_date") < F.date_add(F.lit(_dt.date.fromisoformat(str(end_due_date))), 1))
    s = s.withColumn("_job_key", norm_key("job_number")).alias("s")
    jm = erp.job_master.select(norm_key("job_number").alias("jm_key"),
                               text_to_decimal("tool_impressions").alias("jm_castings_per_mold"))
    o = (orders_by_job_history(erp) if orders is None else orders).alias("o")
    j = (s.join(jm, jm.jm_key == F.col("s._job_key"), "left")
         .join(o, F.col("o.job_key") == F.col("s._job_key"), "left"))
    return j.select(
        F.col("s.job_number").alias("job_number"),
        F.col("o.customer_po"), F.col("o.quantity_ordered"), F.col("o.quantity_shipped_to_date"),
        F.col("o.ship_date"), F.col("o.total_value"),
        F.col("s.pour_weight"),
        _dec(total_pour_fallback("s.total_pour_wt", "s.pour_weight", "s.quantity_of_molds")).alias("total_pour_wt"),
        F.coalesce(F.col("jm_castings_per_mold"), F.lit(0)).alias("castings_per_mold"),
        F.col("s.quantity_of_cores"), F.col("s.castings_produced"), F.col("s.molds_completed"))


def dashboard_rows(spark, erp: ErpViews, database: str | None = None, **window):
    """Source choice from the catalog: ``("history", rows)`` when the run and snapshot tables
    exist, otherwise ``("live", open_orders)``.  The two shapes differ (12 vs 18 columns), so the
    result is tagged; errors in the history plan are raised, not hidden."""
    from castplan.sources.catalog import history_available
    if history_available(spark, database):
        table = (lambda t: spark.table(f"{database}.{t}" if database else t))
        return "history", dashboard_history(erp, table("order_snapshot"), table("scheduler_run"), **window)
    return "live", open_orders(erp)


def materialize_order_lines(erp: ErpViews, path: str) -> ErpViews:
    """Write the order lines once as Parquet (``d`` and ``h`` as structs, so readers keep
    nested column pruning) and return views that read them from there."""
    from dataclasses import replace
    lines = order_lines(erp).select(F.struct("d.*").alias("d"), F.struct("h.*").alias("h"))
    lines.write.mode("overwrite").parquet(path)
    return replace(erp, lines=lines.sparkSession.read.parquet(path))
