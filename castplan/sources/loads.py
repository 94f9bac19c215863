"""Loads that change several partitioned tables at once.

A load writes its rows into folders of its own, ``<table>/<partition>/load=<token>``, which no reader sees.
``commit`` then writes one manifest, which names the live folder of every partition of every
table: the tables change together or not at all, whatever step fails.  A partition that the load replaces and
has no rows for is no longer named.  Readers take the newest manifest and read the folders that it names, with
the partition column pruned by filters.  The manifest before stays readable, older folders are
deleted.  One load at a time: a load that finds another's manifest in its place fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, root: str) -> list:
    fs, p = _fs(spark, f"{root}/_manifest")
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _load_manifest(spark: SparkSession, root: str, n: int) -> dict:
    fs, p = _fs(spark, f"{root}/_manifest/{n:08d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> dict:
    """``{table: {"partition", "schema", "live": {value: token}}}`` of the newest load; empty before the first."""
    known = _manifests(spark, root)
    return _load_manifest(spark, root, known[-1]) if known else {}


def _folder(root: str, table: str, partition: str, value: str, token: str) -> str:
    return f"{root}/{table}/{partition}={value}/load={token}"


def _read(spark: SparkSession, root: str, table: str, entry: dict) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    paths = [_folder(root, table, entry["partition"], v, t) for v, t in sorted(entry["live"].items())]
    if not paths:
        return spark.createDataFrame([], schema)
    # the basePath makes the folders' names partition columns
    return (spark.read.schema(T.StructType([*schema.fields, T.StructField("load", T.StringType())]))
            .option("basePath", f"{root}/{table}").parquet(*paths).select(*schema.names))


def read(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The table as the newest load left it, or None if no load ever wrote it."""
    entry = current(spark, root).get(table)
    return _read(spark, root, table, entry) if entry else None


class Load:
    """One load: ``write`` any tables, then ``commit``; or ``abandon``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.before = (_manifests(spark, root) or [0])[-1]
        self.tables = _load_manifest(spark, root, self.before) if self.before else {}
        self.token = f"{self.before + 1:08d}-{uuid.uuid4().hex[:8]}"
        self.written: dict = {}

    def read(self, table: str) -> DataFrame | None:
        """The table before this load."""
        return _read(self.spark, self.root, table, self.tables[table]) if table in self.tables else None

    def write(self, df: DataFrame, table: str, partition: str, replaces) -> DataFrame:
        """Write ``df`` as the new rows of the partitions ``replaces``; returns them read back."""
        path = f"{self.root}/{table}"
        df.withColumn("load", F.lit(self.token)).write.mode("append").partitionBy(partition, "load").parquet(path)
        fs, pattern = _fs(self.spark, f"{path}/{partition}=*/load={self.token}")
        found = [x.getPath().getParent().getName().split("=", 1)[1] for x in fs.globStatus(pattern)]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        mine = {"partition": partition, "schema": schema.json(), "live": {v: self.token for v in found}}
        stray = set(found) - {str(v) for v in replaces}
        if stray:
            raise ValueError(f"{table}: rows of partitions that the load doesn't replace: {sorted(stray)}")
        kept = {v: t for v, t in self.tables.get(table, {"live": {}})["live"].items() if v not in {str(r) for r in replaces}}
        self.written[table] = {**mine, "live": {**kept, **mine["live"]}}
        return _read(self.spark, self.root, table, mine)

    def commit(self) -> None:
        """Publish what was written, all tables at once."""
        after = {**self.tables, **self.written}
        fs, place = _fs(self.spark, f"{self.root}/_manifest/{self.before + 1:08d}.json")
        draft = _fs(self.spark, f"{self.root}/_manifest/.{self.token}")[1]
        out = fs.create(draft)
        out.write(json.dumps(after).encode())
        out.close()
        if fs.exists(place) or not fs.rename(draft, place):
            self.abandon()
            raise RuntimeError("another load was published meanwhile; load again")
        self._clean(after)

    def abandon(self) -> None:
        """Delete what was written; the tables are as they were."""
        for table, entry in self.written.items():
            for value, token in entry["live"].items():
                if token == self.token:
                    fs, p = _fs(self.spark, _folder(self.root, table, entry["partition"], value, token))
                    fs.delete(p, True)

    def _clean(self, after: dict) -> None:
        """Delete the folders that only the manifest before the last one names, and that manifest."""
        for n in _manifests(self.spark, self.root):
            if n < self.before:
                for table, entry in _load_manifest(self.spark, self.root, n).items():
                    for value, token in entry["live"].items():
                        if all(token != m.get(table, {"live": {}})["live"].get(value) for m in (self.tables, after)):
                            fs, p = _fs(self.spark, _folder(self.root, table, entry["partition"], value, token))
                            fs.delete(p, True)
                fs, p = _fs(self.spark, f"{self.root}/_manifest/{n:08d}.json")
                fs.delete(p, False)


def register_tables(spark: SparkSession, root: str, database: str) -> None:
    """Make the loaded tables of ``root`` partitioned tables of a database of the session's catalog, with the live
    folders as their partitions."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for table, entry in current(spark, root).items():
        partition, schema = entry["partition"], T.StructType.fromJson(json.loads(entry["schema"]))
        name = f"{database}.{table}"
        place = _fs(spark, f"{root}/{table}")[0].makeQualified(_fs(spark, f"{root}/{table}")[1]).toString()
        if spark.catalog.tableExists(name) and not _same_table(spark, name, place, schema):
            spark.sql(f"DROP TABLE {name}")
        if not spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            spark.sql(f"CREATE TABLE {name} ({columns}, `load` string) USING parquet PARTITIONED BY (`{partition}`, `load`) LOCATION '{place}'")
        there = {tuple(x.split("=", 1)[1] for x in r[0].split("/")) for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
        live = set(entry["live"].items())
        for verb, keys in (("ADD IF NOT EXISTS", live - there), ("DROP IF EXISTS", there - live)):
            for value, token in sorted(keys):
                spark.sql(f"ALTER TABLE {name} {verb} PARTITION (`{partition}` = {value}, `load` = '{token}')")
        spark.catalog.refreshTable(name)


def _same_table(spark: SparkSession, name: str, place: str, schema: T.StructType) -> bool:
    facts = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    return facts.get("Location") == place and {f.name for f in schema.fields} | {"load"} == set(spark.table(name).columns)
