"""Data-quality operators: house-account exclusion, required-column validation, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castplan.functions.clean import blank_to_null, norm_key_ws
from castplan.operators.open_orders import order_job_key, order_lines
from castplan.schemas import AUDIT_RETENTION_MONTHS, DEFAULT_HOUSE_ACCOUNTS, REQUIRED_TEXT_COLUMNS
from castplan.sources.adapter import ErpViews


def exclude_customers(df: DataFrame, names=DEFAULT_HOUSE_ACCOUNTS,
                      column: str = "customer_name") -> DataFrame:
    """Drop rows whose customer (whitespace-stripped, upper-cased) is in ``names``.

    Short lists become an ``isin`` predicate; long lists should be a DataFrame passed to
    ``exclude_customers_df`` (left anti join) instead.
    """
    normalized = sorted({str(n).strip().upper() for n in names})
    return df.where(~norm_key_ws(column).isin(*normalized))


def exclude_customers_df(df: DataFrame, names_df: DataFrame, name_col: str = "name",
                         column: str = "customer_name") -> DataFrame:
    keys = names_df.select(norm_key_ws(name_col).alias("_excl")).distinct()
    return df.join(keys, norm_key_ws(column) == keys._excl, "left_anti")


def validation_summary(df: DataFrame, required=REQUIRED_TEXT_COLUMNS,
                       job_column: str = "job_number", samples: int = 5) -> DataFrame:
    """Row count and, per required column, the blank count and up to ``samples`` sample jobs
    (smallest job numbers) among the blank rows.

    Counts come from one aggregate pass.  Samples are a top-k per column: blank (column,
    job) pairs, deduplicated, ranked with ``row_number() <= k`` — Spark plans that as a
    per-partition group limit before the shuffle, so no column's blank rows gather in one
    task.  Result: one row per required column.
    """
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for c in required:
        aggs.append(F.count_if(blank_to_null(c).isNull()).alias(f"blank__{c}"))
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `blank__{c}`" for c in required)
    counts = one.selectExpr("total_rows", f"stack({len(required)}, {stack}) AS (column_name, blank_rows)")
    job = F.coalesce(F.col(job_column).cast("string"), F.lit(""))
    flags = F.array(*[F.when(blank_to_null(c).isNull(), F.lit(c)) for c in required])
    pairs = (df.select(job.alias("job"), F.explode(flags).alias("column_name"))
             .where(F.col("column_name").isNotNull()))
    w = Window.partitionBy("column_name").orderBy("job")
    top = (pairs.distinct().withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= samples)
           .groupBy("column_name")
           .agg(F.array_join(F.array_sort(F.collect_list("job")), ", ").alias("sample_jobs")))
    return (counts.join(top, "column_name", "left")
            .withColumn("sample_jobs", F.coalesce(F.col("sample_jobs"), F.lit(""))))


def validate_rows(df: DataFrame, required=REQUIRED_TEXT_COLUMNS, job_column="job_number") -> DataFrame:
    """Raise ``RuntimeError`` when there are no rows or a required column has blanks.

    Runs ``validation_summary`` (a single aggregate job, one small row per column) and returns
    ``df`` unchanged otherwise.  Blank alloy is allowed.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise RuntimeError("Input validation failed: missing column: " + ", ".join(missing))
    rows = validation_summary(df, required, job_column).collect()
    if not rows or rows[0]["total_rows"] == 0:
        raise RuntimeError("Input validation failed: no rows were returned after the "
                           "join/mapping; no matching job keys were found.")
    issues = [f"{r['column_name']}: {r['blank_rows']} blank rows"
              + (f" (sample jobs: {r['sample_jobs']})" if r["sample_jobs"] else "")
              for r in rows if r["blank_rows"]]
    if issues:
        raise RuntimeError("Input validation failed, incomplete rows: " + "; ".join(issues))
    return df


def missing_job_lines(erp: ErpViews) -> DataFrame:
    """Order lines whose job key is blank in both detail and header."""
    lines = order_lines(erp)
    return (lines.where(order_job_key(F.col("d.job_number"), F.col("h.job_number")).isNull()
                        | (order_job_key(F.col("d.job_number"), F.col("h.job_number")) == ""))
            .select(F.col("h.order_number").alias("order_number"),
                    F.col("d.line_number").alias("line_number"),
                    F.col("h.customer_name").alias("customer_name"),
                    F.col("d.product_number").alias("part_number"),
                    F.col("d.job_number").alias("detail_job_number"),
                    F.col("h.job_number").alias("header_job_number"),
                    F.col("h.ship_date").alias("ship_date")))


def missing_job_audit(erp: ErpViews, source_label: str = "live", top: int = 10) -> DataFrame:
    """Missing-job audit: total count plus the first ``top`` lines by (order, line).

    Output: one row per sample line carrying ``missing_count`` and the ``source`` label; with no
    missing line, one row with the count 0 and null line columns.  Top-k is the feature here
    (TakeOrderedAndProject, no full sort).
    """
    lines = missing_job_lines(erp)
    total = lines.agg(F.count(F.lit(1)).alias("missing_count"))
    sample = (lines.drop("ship_date")
              .orderBy("order_number", "line_number", "customer_name", "part_number",
                       "detail_job_number", "header_job_number")
              .limit(top))
    found = sample.withColumn("missing_count", total.scalar())
    none = total.where("missing_count = 0").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in sample.schema.fields], "missing_count")
    return found.unionByName(none).withColumn("source", F.lit(source_label))


def audit_by_month(erp: ErpViews, keep_months: int = AUDIT_RETENTION_MONTHS) -> DataFrame:
    """Monthly missing-job audit blocks with retention: newest ``keep_months`` months kept.

    Months come from the order ship date; retention looks at the (few) month keys of the
    aggregated rows only.  Lines without a ship date form a block of their own (month NULL),
    which retention leaves in place.
    """
    per_month = (missing_job_lines(erp)
                 .groupBy(F.date_format("ship_date", "yyyy-MM").alias("month"))
                 .agg(F.count(F.lit(1)).alias("missing_count"),
                      F.min("order_number").alias("first_order")))
    newest = per_month.select("month").where("month IS NOT NULL").orderBy(F.desc("month")).limit(keep_months)
    dated = per_month.join(F.broadcast(newest), "month", "left_semi")  # at most keep_months rows
    return dated.unionByName(per_month.where("month IS NULL"))
