"""Working-day calendar (weekdays only) and day-number resolution.

Day ``n`` of a schedule that starts on ``start_date`` is ``n - 1`` business days after the
first weekday on or after the start.  Because that is a closed form, resolving a day number
to a date is a projection (``day_date``) — no calendar join, no shuffle, no broadcast — and
it extrapolates naturally to days beyond the calendar's last day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castplan.functions.clean import col_
from castplan.functions.dates import add_business_days, as_date_lit, weekday_name


def first_weekday_on_or_after(d) -> Column:
    d = as_date_lit(d)
    wd = F.weekday(d)
    return F.when(wd >= 5, F.date_add(d, 7 - wd)).otherwise(d)


def day_date(day, start_date) -> Column:
    """Calendar date of schedule day ``day`` (NULL day gives NULL)."""
    d = col_(day)
    return F.when(d.isNotNull(),
                  add_business_days(first_weekday_on_or_after(start_date), d.cast("int") - 1))


def business_calendar(days: DataFrame, start_date, day_col: str = "day") -> DataFrame:
    """Calendar rows ``day, date, weekday`` for days 1..max(``day_col``) of ``days``.

    The last day is one scalar; the rows come from a distributed ``range``.
    """
    top = days.agg(F.max(day_col)).first()[0]
    spark = days.sparkSession
    cal = spark.range(1, int(top or 0) + 1).select(F.col("id").cast("int").alias("day"))
    return cal.select("day", day_date(F.col("day"), start_date).alias("date")) \
        .withColumn("weekday", weekday_name("date"))
