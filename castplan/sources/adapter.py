"""ERP-shaped views derived from the driver's TPC-H-style tables.

The planning operators consume ERP tables (order header/detail, job master, item master,
heat list).  The driver ships TPC-H-style parquet instead, so each ERP table is defined here
as a deterministic expression over those tables; the SQL oracle defines the same views with
the same arithmetic.  Key decisions:

* ``oe_header``  one row per order (orders left-join customer); mixed-encoding required date
* ``oe_detail``  one row per lineitem; job key ``' j<partkey>'`` with blank keys for some parts
* ``job_master`` one row per part (part left-join customer; part p belongs to customer p % 100 + 1)
* ``ic_master``  one row per part; base material (alloy) = ``p_type``
* ``jc_heat``    one (job, heat) row per order line, heat derived from the supplier
* ``pool``       capacity pool of a job: a plant makes ``PARTS_PER_POOL`` parts, so pools grow with the data

All arithmetic is on integer keys, never on row order, so both engines agree.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castplan.schemas import DAY_OFFSET_EPOCH

PARTS_PER_POOL = 80
CUSTOMER_CYCLE = 100
EPOCH = _dt.date.fromisoformat(DAY_OFFSET_EPOCH)
JOB_DUE_BASE = _dt.date(2001, 5, 1)


_READ_CACHE: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table of the driver data.  The (lazy) DataFrame is memoised per session and
    path so that file listing and footer reads happen once per session, not per query."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    df = _READ_CACHE.get(key)
    if df is None:
        df = _READ_CACHE[key] = spark.read.parquet(key[1])
    return df


def _encode_date(d, selector):
    """Render a date as ISO / yyyyMMdd / day-offset text or junk, with and without tails,
    chosen by ``selector``."""
    return (F.when(selector == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(selector == 1, F.date_format(d, "yyyyMMdd"))
            .when(selector == 2, F.datediff(d, F.lit(EPOCH)).cast("string"))
            .when(selector == 3, F.lit("TBD"))
            .when(selector == 5, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T08:30:00")))
            .when(selector == 6, F.concat(F.date_format(d, "yyyyMMdd"), F.lit(" rush")))
            .when(selector == 7, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("xyz")))
            .when(selector == 8, F.lit("-400")))


def oe_header(spark, sf_dir) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("o_orderkey")
    due = F.date_add(F.col("o_orderdate").cast("date"), 90)
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
            .select(k.alias("order_number"),
                    F.col("c_name").alias("customer_name"),
                    F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("PO-"), k.cast("string")))
                    .alias("customer_po"),
                    F.date_add(F.col("o_orderdate").cast("date"), 30).alias("ship_date"),
                    F.when(k % 4 == 0, F.concat(F.lit("J"), (k % 1000).cast("string")))
                    .otherwise(F.lit("")).alias("job_number"),
                    _encode_date(due, k % 9).alias("required_date")))


def oe_detail(spark, sf_dir) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        "l_linestatus", "l_shipdate")
    p = F.col("l_partkey")
    due = F.date_add(F.col("l_shipdate").cast("date"), 45)
    sel = (F.col("l_orderkey") + F.col("l_linenumber")) % 10
    return li.select(
        F.col("l_orderkey").alias("order_number"),
        F.col("l_linenumber").alias("line_number"),
        F.concat(p.cast("string"), F.when(p % 2 == 0, F.lit(" ")).otherwise(F.lit("")))
        .alias("product_number"),
        F.when(F.col("l_linenumber") == 1, F.lit("JOB")).alias("job_type"),
        F.col("l_quantity").cast("decimal(18,4)").alias("quantity_ordered"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(F.lit(0.0))
        .cast("decimal(18,4)").alias("pieces_shipped_to_date"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("extended_order_value"),
        F.when(p % 50 == 0, F.lit("")).when(p % 50 == 1, F.lit("   "))
        .otherwise(F.concat(F.lit(" j"), p.cast("string"))).alias("job_number"),
        _encode_date(due, sel).alias("required_date"),
    )


def job_master(spark, sf_dir) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_retailprice")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("p_partkey")
    size = F.col("p_size")
    price = F.col("p_retailprice")
    price_text = price.cast("string")
    return (part.join(cust, part.p_partkey % CUSTOMER_CYCLE + 1 == cust.c_custkey, "left")
            .select(
                F.when(k % 7 == 0, F.concat(F.lit("j"), k.cast("string"), F.lit(" ")))
                .otherwise(F.concat(F.lit("J"), k.cast("string"))).alias("job_number"),
                F.when(k % 13 == 0, F.lit("C")).otherwise(F.lit("I")).alias("job_status_flag"),
                F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(k.cast("string"))
                .alias("product_code"),
                F.when(k % 31 == 0, F.lit(" House Account ")).when(k % 37 == 0, F.lit("  "))
                .otherwise(F.col("c_name")).alias("customer_name"),
                F.when(k % 20 == 0, F.lit("IFA")).when(k % 20 == 1, F.lit("ifc"))
                .otherwise(F.lit("JOB")).alias("job_type"),
                F.when(k % 9 == 0, F.lit("F")).when(k % 9 == 1, F.lit("I"))
                .when(k % 9 == 2, F.lit(" f ")).when(k % 9 == 3, F.lit(None).cast("string"))
                .otherwise(F.lit("L")).alias("casting_type"),
                F.when(k % 11 == 0, F.lit("þ")).when(k % 11 == 1, F.lit("o"))
                .alias("job_on_hold"),
                (size * 2).cast("decimal(18,4)").alias("quantity_required"),
                F.when(size % 10 == 9, F.lit("n/a")).otherwise((size % 6).cast("string"))
                .alias("tool_impressions"),
                (k % 17 + 1).cast("decimal(18,4)").alias("molds_required"),
                (size % 4).cast("string").alias("cores_text"),
                F.when(k % 4 == 0, F.concat(F.lit("$"), price_text))
                .when(k % 4 == 1, F.concat(F.lit("1,"), price_text))
                .when(k % 4 == 2, price_text).otherwise(F.lit("n/a")).alias("pour_weight_text"),
                F.when(k % 6 == 0, price * 3).otherwise(F.lit(0.0)).cast("decimal(18,4)")
                .alias("pour_quantity"),
                F.when(k % 4 == 0, F.lit(None)).otherwise(price * 10).cast("decimal(18,4)")
                .alias("contract_revised_amount"),
                (price * 9).cast("decimal(18,4)").alias("contract_original_amount"),
                ((k % 5) * 2).cast("decimal(18,4)").alias("quantity_produced"),
                (k % 5).cast("decimal(18,4)").alias("molds_produced"),
                F.when(k % 8 == 0, F.concat(F.lit("H"), k.cast("string"))).alias("heat_number"),
                F.when(k % 3 == 0, F.date_format(F.date_add(F.lit(JOB_DUE_BASE), (k % 120).cast("int")),
                                                 "yyyy-MM-dd")).alias("due_date_text"),
                F.floor(k / PARTS_PER_POOL).cast("int").alias("pool"),
            ))


def ic_master(spark, sf_dir) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    k = F.col("p_partkey")
    return part.select(k.cast("string").alias("product_code"),
                       F.when(k % 29 == 0, F.lit("")).otherwise(F.col("p_type"))
                       .alias("base_material"))


def jc_heat(spark, sf_dir) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    s = F.col("l_suppkey")
    return (li.select(F.concat(F.lit("J"), F.col("l_partkey").cast("string")).alias("job_number"),
                    F.when(s % 7 == 0, F.concat(F.lit("X"), (s % 3).cast("string")))
                    .otherwise((s % 12).cast("string")).alias("heat_number")))


@dataclass
class ErpViews:
    oe_header: DataFrame
    oe_detail: DataFrame
    job_master: DataFrame
    ic_master: DataFrame
    jc_heat: DataFrame
    lines: DataFrame | None = None  # materialised order lines (structs ``d`` and ``h``)


def erp_views(spark: SparkSession, sf_dir: str) -> ErpViews:
    return ErpViews(oe_header(spark, sf_dir), oe_detail(spark, sf_dir),
                    job_master(spark, sf_dir), ic_master(spark, sf_dir),
                    jc_heat(spark, sf_dir))


def order_snapshot(spark, sf_dir, runs: int = 3) -> DataFrame:
    """Typed history snapshot: one row per (run, open job); a job drops out of the runs in
    which its completed molds have reached the molds required (it is finished).

    Stands in for the typed snapshot a daily load produces (see ``sources.history``).
    Molds completed and castings produced grow with the run number.
    """
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    r = F.col("run_id")
    base = part.select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run_id"))
    return (base.where(k % 5 + r - 1 < k % 17 + 1)
            .select(r.cast("long").alias("run_id"),
                    F.when(k % 7 == 0, F.concat(F.lit("j"), k.cast("string"), F.lit(" ")))
                    .otherwise(F.concat(F.lit("J"), k.cast("string"))).alias("job_number"),
                    F.when(k % 3 == 0, F.date_add(F.lit(JOB_DUE_BASE), (k % 120).cast("int")))
                    .otherwise(F.date_add(F.lit(_dt.date(2001, 1, 1)), (k % 200).cast("int")))
                    .alias("due_date"),
                    F.col("p_retailprice").cast("decimal(18,4)").alias("pour_weight"),
                    F.when(k % 6 == 0, F.col("p_retailprice") * 3).otherwise(F.lit(0.0))
                    .cast("decimal(18,4)").alias("total_pour_wt"),
                    (k % 17 + 1).cast("decimal(18,4)").alias("quantity_of_molds"),
                    (F.col("p_size") % 4).cast("decimal(18,4)").alias("quantity_of_cores"),
                    ((k % 5) * 2 * r).cast("decimal(18,4)").alias("castings_produced"),
                    (k % 5 + r - 1).cast("decimal(18,4)").alias("molds_completed")))


def scheduler_run(spark, sf_dir, runs: int = 3) -> DataFrame:
    """Run registry matching ``order_snapshot``: one row per run with its row count."""
    snap = order_snapshot(spark, sf_dir, runs)
    return snap.groupBy("run_id").agg(F.count(F.lit(1)).alias("row_count"))


# The compatibility reference rows used with the driver tables (alloys are the
# six ``p_type`` values).  Columns: alloy_code, compatibility_group, Is_Compat_with_All,
# compatible_specific_alloys, is_active, file_line.  Exercises: case/space normalisation,
# a blank group, an inactive row, a blank key, a duplicate key where the last row wins.
COMPAT_REFERENCE_ROWS = [
    ("economy", "G1", "yes", "", "Y", 1),
    ("SMALL", "G1", "NO", "economy, ,ECONOMY,medium", "", 2),
    ("MEDIUM", "G2", "N", "promo", "TRUE", 3),
    ("PROMO", "G2", "1", "", None, 4),
    ("STANDARD", "", "YES", "", "Y", 5),
    ("LARGE", "G3", "YES", "", "N", 6),
    ("SMALL ", "G1", "no", "economy, promo", "y", 7),
    ("", "G9", "YES", "", "Y", 8),
]


def compat_reference(spark: SparkSession) -> DataFrame:
    """The compatibility reference table (small, fixed reference data)."""
    return spark.createDataFrame(
        COMPAT_REFERENCE_ROWS,
        "alloy_code string, compatibility_group string, Is_Compat_with_All string, "
        "compatible_specific_alloys string, is_active string, file_line long")
