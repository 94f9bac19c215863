"""File readers: open-order report extract, compatibility reference, ERP snapshot CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castplan.functions.clean import blank_to_null, molds_needed, strip_headers, text_to_decimal, with_defaults
from castplan.functions.dates import decode_erp_date, to_date_or_null
from castplan.operators.ordinal import file_ordinal
from castplan.schemas import HEADER_TO_COLUMN, NUMERIC_OPEN_ORDER_COLUMNS, OPEN_ORDER_COLUMNS, OPEN_ORDER_HEADERS


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("text").load(path).limit(0).collect()
        return True
    except Exception as exc:  # noqa: BLE001 - the reader raises a generic analysis error
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return False
        raise


def read_open_order_report(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read an open-order report extract (CSV with header, or Parquet), strip the headers,
    rename report headers to column names, number the rows in file order (``row_seq``) and type the
    columns (``typed_report``).  Columns the
    report already carries (Molds Needed, Hold, Scheduled) are kept as given — the report-only run
    trusts the sheet."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = strip_headers(file_ordinal(reader.format(fmt).load(path)))
    return typed_report(df.toDF(*[HEADER_TO_COLUMN.get(c, c) for c in df.columns]))


def typed_report(df: DataFrame) -> DataFrame:
    """Report text to typed columns: dates and numbers that can't be read are NULL, blank text is
    NULL, missing columns get their defaults, a report without a pool is one pool (0)."""
    numbers = [c for c in (*NUMERIC_OPEN_ORDER_COLUMNS, "molds_needed") if c in df.columns]
    text = [c for c in OPEN_ORDER_COLUMNS if c in df.columns and c not in numbers and c != "due_date"]
    due = {"due_date": F.coalesce(decode_erp_date("due_date"), to_date_or_null("due_date"))} if "due_date" in df.columns else {}
    df = df.withColumns({**{c: text_to_decimal(c, 18, 4, default=None) for c in numbers}, **{c: blank_to_null(c) for c in text}, **due})
    df = with_defaults(df, {"quantity_of_molds": 0, "molds_completed": 0, "pour_weight": 0, "hold": "NO", "scheduled": "NO", "job_number": "",
                            "job_type": "", "alloy": "", "casting_type": "", "customer_name": "", "part_number": ""})
    if "due_date" not in df.columns:
        df = df.withColumn("due_date", F.lit(None).cast("date"))
    if "molds_needed" not in df.columns:
        df = df.withColumn("molds_needed", molds_needed("quantity_of_molds", "molds_completed"))
    pool = F.coalesce(F.col("pool").cast("string").try_cast("int"), F.lit(0)) if "pool" in df.columns else F.lit(0)
    return df.withColumn("pool", pool)


def load_compat_table(spark: SparkSession, path: str) -> DataFrame:
    """Compatibility reference CSV; a missing file gives an empty table (no mappings).

    ``file_line`` preserves file order (ids increase with the file offset) so that the
    last row of a duplicated alloy wins.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "alloy_code string, compatibility_group string, "
                                         "Is_Compat_with_All string, file_line long")
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return strip_headers(df).withColumn("file_line", F.monotonically_increasing_id())


def read_snapshot_csv(spark: SparkSession, path: str) -> DataFrame:
    """ERP export CSV, every column as text.  Raises when a required column is missing or
    the file has no rows."""
    df = strip_headers(spark.read.option("header", True).option("inferSchema", False).csv(path))
    missing = [c for c in OPEN_ORDER_HEADERS if c not in df.columns]
    if missing:
        raise RuntimeError("Snapshot CSV is missing required columns: " + ", ".join(missing))
    if df.isEmpty():
        raise RuntimeError("The snapshot export has no data rows.")
    return df.select(*[F.col(f"`{h}`").cast(T.StringType()).alias(h) for h in OPEN_ORDER_HEADERS])
