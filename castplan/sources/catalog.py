"""Schema discovery through the Spark catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def list_tables(spark: SparkSession, database: str | None = None, include_views: bool = False) -> DataFrame:
    """Tables (and optionally views) of a database as a DataFrame ``schema, name, type``."""
    rows = [(t.database or database or "", t.name, "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE")
            for t in spark.catalog.listTables(database)
            if include_views or t.tableType not in ("VIEW", "TEMPORARY")]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "schema string, name string, type string")


def list_columns(spark: SparkSession, table: str, database: str | None = None) -> DataFrame:
    """Columns of a table in ordinal order: ``schema, table, name, type, nullable, ordinal``."""
    cols = spark.catalog.listColumns(table, database)
    rows = [(database or "", table, c.name, c.dataType, "YES" if c.nullable else "NO", i + 1)
            for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "schema string, table string, name string, type string, "
                                       "nullable string, ordinal int")


def table_exists(spark: SparkSession, table: str, database: str | None = None) -> bool:
    return spark.catalog.tableExists(f"{database}.{table}" if database else table)


def history_available(spark: SparkSession, database: str | None = None) -> bool:
    """True when both history tables exist (scheduler runs and order snapshots)."""
    return table_exists(spark, "scheduler_run", database) and table_exists(spark, "order_snapshot", database)
