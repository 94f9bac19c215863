"""History tables on partitioned Parquet: run registry, raw and typed snapshots, lifecycle,
report archive, publishing and audit retention.

A load of one or more runs writes their raw rows, their typed rows, the touched buckets of the lifecycle
and the run rows, and publishes all of them with one manifest (``loads.py``): a failure at any step
leaves every table as it was, and a run that is loaded again is replaced wholly, rows that it no
longer has included.  The source is scanned once, by the write of the raw rows, which also
counts them; everything else is made from what was written.  The lifecycle is bucketed by a hash of
the job; a load rewrites the buckets of the jobs it touches.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from castplan.functions.clean import blank_to_null, norm_key, plain_text, text_to_decimal
from castplan.functions.dates import decode_erp_date
from castplan.schemas import AUDIT_RETENTION_MONTHS, HEADER_TO_COLUMN, OPEN_ORDER_HEADERS
from castplan.sources.loads import Load, _fs, current, read, register_tables

#: Buckets of the lifecycle, by a hash of the job number; up to 32 folders are listed without a job.
BUCKETS = 32


def _read_or_none(spark: SparkSession, path: str):
    try:
        return spark.read.parquet(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc) or "UNABLE_TO_INFER" in str(exc):
            return None
        raise


def _write_partitions(df: DataFrame, path: str, partition_cols) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def next_run_id(spark: SparkSession, root: str) -> int:
    """One more than the greatest registered run id, or 1."""
    runs = current(spark, root).get("scheduler_run", {"live": {}})["live"]
    return max(map(int, runs), default=0) + 1


_RUN = "run_id long, run_date date, source_name string, row_count long"


def run_row(spark: SparkSession, run_id: int, run_date, source_name: str, row_count: int) -> DataFrame:
    return spark.createDataFrame([(int(run_id), _dt.date.fromisoformat(str(run_date)), source_name, int(row_count))], _RUN)


def register_run(spark: SparkSession, root: str, run_date, source_name: str, row_count: int,
                 run_id: int | None = None) -> int:
    """Register a run (run id, date, source, row count) without rows and return its id."""
    run_id = run_id or next_run_id(spark, root)
    load = Load(spark, root)
    load.write(run_row(spark, run_id, run_date, source_name, row_count), "scheduler_run", "run_id", [run_id])
    load.commit()
    return run_id


def raw_snapshot_rows(snapshot_text: DataFrame, run_id: int) -> DataFrame:
    """Raw text snapshot rows: ``run_id`` plus each export column as trimmed text (NULL stays
    NULL), named ``<column>_raw``."""
    cols = [F.trim(F.col(f"`{h}`").cast("string")).alias(HEADER_TO_COLUMN[h] + "_raw")
            for h in OPEN_ORDER_HEADERS]
    return snapshot_text.select(F.lit(int(run_id)).cast("long").alias("run_id"), *cols)


def transform_raw_snapshot(raw: DataFrame) -> DataFrame:
    """Raw text -> typed snapshot: decoded due date, decimals for quantities and money
    (``$`` and ``,`` removed; unparseable -> NULL), text keys cleaned, hold as YES/NO."""
    r = lambda c: F.col(c + "_raw")
    dec = lambda c: text_to_decimal(r(c), 18, 4, default=None)
    return raw.select(
        "run_id",
        F.coalesce(decode_erp_date(r("due_date")),
                   r("due_date").try_cast("timestamp").cast("date")).alias("due_date"),
        blank_to_null(r("customer_name")).alias("customer_name"),
        blank_to_null(r("part_number")).alias("part_number"),
        blank_to_null(r("job_type")).alias("job_type"),
        norm_key(r("job_number")).alias("job_number"),
        blank_to_null(r("alloy")).alias("alloy"),
        blank_to_null(r("casting_type")).alias("casting_type"),
        dec("qty_ordered").alias("qty_ordered"), dec("quantity_of_molds").alias("quantity_of_molds"),
        dec("castings_per_mold").alias("castings_per_mold"),
        dec("quantity_of_cores").alias("quantity_of_cores"), dec("pour_weight").alias("pour_weight"),
        dec("total_pour_wt").alias("total_pour_wt"), dec("total_value").alias("total_value"),
        blank_to_null(r("heat_no_assigned")).alias("heat_no_assigned"),
        dec("castings_produced").alias("castings_produced"), dec("molds_completed").alias("molds_completed"),
        F.when(F.upper(F.trim(r("on_hold"))) == "YES", "YES").otherwise("NO").alias("on_hold"),
    ).where(F.col("job_number").isNotNull() & (F.col("job_number") != ""))


def upsert_lifecycle(lifecycle: DataFrame | None, typed: DataFrame) -> DataFrame:
    """Lifecycle per job: the latest typed row plus first/last seen run, the runs seen and their
    number.  ``typed`` holds one or more runs that the lifecycle hasn't seen.

    One aggregate per job, combined before the shuffle; of several rows of a job in its latest run
    the one of the greatest row hash stays.
    """
    cols = typed.columns
    new = typed.withColumn("run_ids", F.array("run_id"))
    both = new if lifecycle is None else lifecycle.select(*cols, "run_ids").unionByName(new)
    one = both.groupBy(F.col("job_number").alias("_job")).agg(
        F.max_by(F.struct(*cols), F.struct("run_id", F.xxhash64(*cols))).alias("_row"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("run_ids")))).alias("run_ids"))
    return one.select(*[F.col(f"_row.{c}").alias(c) for c in cols], F.array_min("run_ids").alias("first_seen_run"),
                      F.array_max("run_ids").alias("last_seen_run"), F.size("run_ids").cast("long").alias("runs_seen"), "run_ids")


def _bucket(job):
    return F.pmod(F.xxhash64(job), F.lit(BUCKETS)).cast("int")


def read_lifecycle(spark: SparkSession, root: str) -> DataFrame | None:
    life = read(spark, root, "order_lifecycle")
    return None if life is None else life.drop("bucket")


def _write_lifecycle(load: Load, typed: DataFrame, run_ids: list) -> None:
    """The lifecycle once ``typed`` (all rows of ``run_ids``) is loaded, in the buckets that change.

    New runs are folded in.  Where one of the runs was loaded before, the jobs that it touched then
    or touches now are derived anew from the typed rows of all their runs; no other job changes.
    """
    ids = [int(r) for r in run_ids]
    rows, old = load.read("order_snapshot"), load.read("order_lifecycle")
    loaded = set(load.tables.get("order_snapshot", {"live": {}})["live"]) & {str(r) for r in ids}
    jobs = typed.select("job_number")
    if loaded:
        jobs = jobs.union(rows.where(F.col("run_id").isin(*map(int, loaded))).select("job_number")).distinct()
    buckets = [r[0] for r in jobs.select(_bucket("job_number")).distinct().collect()]
    if old is not None:
        old = old.where(F.col("bucket").isin(*buckets)) if buckets else old.limit(0)
    if not loaded:
        new = upsert_lifecycle(old, typed)
    else:
        earlier = rows.where(~F.col("run_id").isin(*ids)).join(jobs, "job_number", "left_semi").select(typed.columns)
        new = upsert_lifecycle(None, earlier.unionByName(typed))
        new = old.join(jobs, "job_number", "left_anti").select(new.columns).unionByName(new)
    # adaptive execution cuts large buckets and joins small ones
    load.write(new.withColumn("bucket", _bucket("job_number")).hint("rebalance", "bucket"), "order_lifecycle", "bucket", buckets)


def fold_typed(spark: SparkSession, typed: DataFrame, root: str, run_ids: list) -> None:
    """Load typed rows of ``run_ids`` and fold them into the lifecycle, at once."""
    load = Load(spark, root)
    _write_lifecycle(load, load.write(typed, "order_snapshot", "run_id", run_ids), run_ids)
    load.commit()


def load_runs(load: Load, raw: DataFrame, run_ids: list, skip_transform: bool = False) -> DataFrame:
    """Write all rows of ``run_ids`` (raw text with ``run_id``) and what follows from them; returns the raw rows
    as written.  With ``skip_transform`` the runs have raw rows only."""
    raw = load.write(raw, "order_snapshot_raw", "run_id", run_ids)
    known = set(load.tables.get("order_snapshot", {"live": {}})["live"]) & {str(r) for r in run_ids}
    if not skip_transform or known:
        typed = transform_raw_snapshot(raw.limit(0) if skip_transform else raw)
        _write_lifecycle(load, load.write(typed, "order_snapshot", "run_id", run_ids), run_ids)
    return raw


def load_snapshot(spark: SparkSession, snapshot_text: DataFrame, root: str, run_date, source_name: str,
                  run_id: int | None = None, skip_transform: bool = False, database: str | None = None) -> int:
    """Historical snapshot load: raw rows, then (unless ``skip_transform``) typed rows and the
    lifecycle, and the run's registration.  Returns the run id.  Loading a run again replaces
    it.  With a ``database`` the tables are those of the session's catalog afterwards."""
    run_id = run_id or next_run_id(spark, root)
    load, counted = Load(spark, root), Observation()
    try:
        raw = raw_snapshot_rows(snapshot_text, run_id).observe(counted, F.count(F.lit(1)).alias("rows"))
        load_runs(load, raw, [run_id], skip_transform)
        rows = counted.get["rows"]
        if rows == 0:
            raise RuntimeError("The snapshot export has no data rows.")
        load.write(run_row(spark, run_id, run_date, source_name, rows), "scheduler_run", "run_id", [run_id])
    except Exception:
        load.abandon()
        raise
    load.commit()
    if database:
        register_tables(spark, root, database)
    return run_id


def save_text_snapshot(df: DataFrame, path: str, snapshot_ts: str) -> None:
    """Save rows as a dated plain-text snapshot (NULL -> '', dates as yyyy-MM-dd)."""
    cols = [plain_text(f.name, is_date=f.dataType.typeName() == "date").alias(f.name) for f in df.schema.fields]
    _write_partitions(df.select(*cols).withColumn("snapshot_ts", F.lit(snapshot_ts)), path, ["snapshot_ts"])


def archive_report(spark: SparkSession, df: DataFrame, path: str, as_of_date) -> int:
    """Keep a numbered copy of a report for a day: ``seq = max(seq for that day) + 1``."""
    d = str(as_of_date)
    prev = _read_or_none(spark, path)
    seq = 1
    if prev is not None:
        seq = int(prev.where(F.col("as_of_date") == d).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]) + 1
    _write_partitions(df.withColumns({"as_of_date": F.lit(d), "seq": F.lit(seq)}), path, ["as_of_date", "seq"])
    return seq


def publish_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the current contents of a report table with fresh rows."""
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)


def write_reports(reports: dict, root: str, fmt: str = "parquet") -> list:
    """Publish several named reports, one directory per sheet name; returns the paths."""
    paths = []
    for name, df in reports.items():
        p = f"{root}/{name}"
        publish_report(df, p, fmt)
        paths.append(p)
    return paths


def append_audit(spark: SparkSession, audit: DataFrame, path: str, when: _dt.datetime,
                 keep_months: int = AUDIT_RETENTION_MONTHS) -> DataFrame:
    """Append an audit block to ``when``'s month and drop the months beyond the newest ``keep_months``
    (rows without a month stay).  Files of other months aren't touched."""
    month = when.strftime("%Y-%m")
    block = audit.withColumns({"audit_ts": F.lit(when.strftime("%Y-%m-%d %H:%M:%S")), "month": F.lit(month)})
    block.write.mode("append").partitionBy("month").parquet(path)
    fs, pattern = _fs(spark, f"{path}/month=*")
    months = sorted((x.getPath() for x in fs.globStatus(pattern)), key=lambda p: p.getName(), reverse=True)
    dated = [p for p in months if p.getName() != "month=__HIVE_DEFAULT_PARTITION__"]
    for old in dated[keep_months:]:
        fs.delete(old, True)
    return spark.read.schema(block.schema).parquet(path)
