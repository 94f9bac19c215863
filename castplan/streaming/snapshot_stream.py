"""Incremental snapshot ingestion with Structured Streaming.

Daily ERP export CSVs land in a folder as ``<name>_YYYY-MM-DD.csv``.  The stream finds new files; a
``foreachBatch`` writer checks each file's header, reads its columns by name and loads the
files' runs into the history tables with one commit (``history.load_runs``).  A run id is the
file's date and its number on that day (``20260810001``), so several files of a day are runs of their own, in the
order of their loading; a file that is read again, as in a replayed batch, keeps its id and replaces its run.
A file of no bytes at all is never seen.

Nothing is dropped silently: files without a date in their name, without rows or without a
required column are listed in ``quarantine_files`` with the reason, rows that don't have the header's number of
fields are kept as text in ``quarantine_rows``.  ``trigger(availableNow=True)`` processes what has
landed, at most ``max_files`` files a batch, and stops, which suits a daily schedule; the checkpoint lives under
the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castplan.schemas import HEADER_TO_COLUMN, OPEN_ORDER_HEADERS
from castplan.session import ensure_checkpoint_dir, store
from castplan.sources import history
from castplan.sources.loads import Load, read, register_tables

_DATE = re.compile(r"(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\.csv$")
_BY_DAY = 1000


def headers(spark: SparkSession, files: list) -> dict:
    """``{file: header fields}`` from the first line of every file that has one."""
    lines = (spark.read.text(files).where(F.col("_metadata.file_block_start") == 0)
             .select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at")))
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("line")).collect()  # one line per file of the batch
    return {r["file"]: [c.strip() for c in next(csv.reader([r["line"].removeprefix("﻿")]), [])] for r in first}


def run_ids(spark: SparkSession, root: str, files: list) -> dict:
    """``{file: run id}``: known files keep theirs, new ones are numbered on their day by name."""
    runs = read(spark, root, "scheduler_run")
    days = {f: int("".join(_DATE.search(f).groups())) for f in files}
    known = {}
    if runs is not None and files:
        own = runs.where(F.floor(F.col("run_id") / _BY_DAY).isin(*set(days.values()))).select("source_name", "run_id").collect()
        known = {r["source_name"]: r["run_id"] for r in own}
    out, last = {}, {}
    for run in known.values():
        last[run // _BY_DAY] = max(last.get(run // _BY_DAY, 0), run % _BY_DAY)
    for f in sorted(files):
        if f in known:
            out[f] = known[f]
        else:
            last[days[f]] = last.get(days[f], 0) + 1
            out[f] = days[f] * _BY_DAY + last[days[f]]
    return out


def read_files(spark: SparkSession, by_header: dict) -> DataFrame:
    """Rows of all files, columns by name, with ``_file`` and, for rows of another length, ``_corrupt``."""
    frames = []
    for names, files in by_header.items():
        columns = [n if n and n not in names[:i] else f"_extra{i}" for i, n in enumerate(names)]
        schema = ", ".join(f"`{c.replace('`', '')}` string" for c in [*columns, "_corrupt"])
        # without pruning every field is parsed, so that rows of another length are seen
        rows = (spark.read.schema(schema).option("header", True).option("columnPruning", False)
                .option("columnNameOfCorruptRecord", "_corrupt").csv(files)
                .withColumn("_file", F.col("_metadata.file_path")))
        frames.append(rows.select("_file", "_corrupt", *[F.col(f"`{h}`") for h in OPEN_ORDER_HEADERS]))
    return reduce(DataFrame.unionByName, frames)


def ingest(spark: SparkSession, root: str, files: list, database: str | None = None) -> None:
    """Load new files as one commit."""
    found = headers(spark, files)
    bad = {f: "no date in the file name" for f in files if not _DATE.search(f)}
    for f in set(files) - set(bad):
        missing = [h for h in OPEN_ORDER_HEADERS if h not in found.get(f, [])]
        if missing:
            bad[f] = "no rows" if f not in found else "missing columns: " + ", ".join(missing)
    by_header: dict = {}
    for f in sorted(set(files) - set(bad)):
        by_header.setdefault(tuple(found[f]), []).append(f)
    load, ids = Load(spark, root), {}
    if by_header:
        rows = store(read_files(spark, by_header), "landed")
        filled = {r["_file"] for r in rows.select("_file").distinct().collect()}  # one row per file of the batch
        bad.update({f: "no rows" for f in sum(by_header.values(), []) if f not in filled})
        ids = run_ids(spark, root, sorted(filled))
    if bad:
        listed = spark.createDataFrame(sorted(bad.items()), "file string, reason string").withColumn("file_key", F.crc32("file"))
        load.write(listed, "quarantine_files", "file_key", [r[0] for r in listed.select("file_key").collect()])
    if ids:
        named = spark.createDataFrame(sorted(ids.items()), "_file string, run_id long")
        rows = rows.join(F.broadcast(named), "_file")  # as long as the batch's list of files
        cols = [F.trim(F.col(f"`{h}`")).alias(HEADER_TO_COLUMN[h] + "_raw") for h in OPEN_ORDER_HEADERS]
        raw = history.load_runs(load, rows.where("_corrupt IS NULL").select("run_id", *cols), list(ids.values()))
        load.write(rows.where("_corrupt IS NOT NULL").select("run_id", F.col("_file").alias("file"), F.col("_corrupt").alias("line")),
                   "quarantine_rows", "run_id", list(ids.values()))
        counts = raw.groupBy("run_id").agg(F.count(F.lit(1)).alias("row_count"))
        runs = named.join(counts, "run_id", "left").select(
            "run_id", F.to_date(F.floor(F.col("run_id") / _BY_DAY).cast("string"), "yyyyMMdd").alias("run_date"),
            F.col("_file").alias("source_name"), F.coalesce("row_count", F.lit(0)).alias("row_count"))
        load.write(runs, "scheduler_run", "run_id", list(ids.values()))
    load.commit()
    if database:
        register_tables(spark, root, database)


def snapshot_stream(spark: SparkSession, landing_dir: str, root: str, checkpoint: str | None = None,
                    database: str | None = None, max_files: int = 1000):
    """Start the availableNow ingestion stream; returns the ``StreamingQuery``."""
    # one row per new file; the writer reads the files
    src = (spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", max_files).text(landing_dir)
           .select(F.col("_metadata.file_path").alias("file")))

    def run(batch: DataFrame, batch_id: int) -> None:
        files = [r["file"] for r in batch.distinct().collect()]
        if files:
            ingest(batch.sparkSession, root, files, database)

    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshot_stream"
    return src.writeStream.foreachBatch(run).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
