import datetime as dt

from pyspark.sql import functions as F

ALLOC_SCHEMA = ("job_number string, alloy string, compatibility_group string, casting_type string, "
                "due_date date, molds_for_ext int, pour_weight double, ext string, pool int")


def alloc_frame(spark, rows):
    """rows: dicts with job, molds and optional alloy/group/cast/due/weight/pool."""
    data = []
    for r in rows:
        due = r.get("due", "2026-08-20")
        data.append((r["job"], r.get("alloy", "A"), r.get("group", "GROUP-A"), r.get("cast", "L"),
                     dt.date.fromisoformat(due) if due else None, r["molds"], float(r.get("weight", 10)),
                     r.get("ext", ""), r.get("pool", 0)))
    return spark.createDataFrame(data, ALLOC_SCHEMA)


def by_day(df, value="molds_for_ext"):
    return {r["schedule_day"]: r["v"] for r in
            df.groupBy("schedule_day").agg(F.sum(value).alias("v")).collect()}
