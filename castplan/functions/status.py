"""Status classifications, colour bands (as categories) and capacity labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from castplan.functions.clean import col_
from castplan.schemas import (RISK_AT_RISK_BELOW_DAYS, RISK_WATCH_BELOW_DAYS,
                              SHIP_BUFFER_TIGHT_BELOW_DAYS, TARGET_POUR_LEAD_DAYS)

__all__ = [
    "risk_status", "risk_diagnostic", "two_week_status", "two_week_note", "schedule_status",
    "on_time_status", "ship_buffer_band", "status_band", "on_time_band", "two_week_band",
    "due_buffer_band", "capacity_label", "job_label", "breakout_text",
]

# Status words and planner texts.
UNKNOWN = "UNKNOWN"
AT_RISK = "AT RISK"
WATCH = "WATCH"
ON_TRACK = "ON TRACK"
RISK_TEXT_UNKNOWN = "No due date available"
RISK_TEXT_AT_RISK = "Pour is less than 14 days before due"
RISK_TEXT_WATCH = "Pour is within a narrow due-date buffer window"
RISK_TEXT_ON_TRACK = "Pour meets the minimum 14-day due buffer"
TWO_WEEK_PASS = "PASS"
TWO_WEEK_EXCEPTION = "EXCEPTION - NO TIME"
TWO_WEEK_VIOLATION = "VIOLATION"
TWO_WEEK_TEXT_UNKNOWN = "Cannot evaluate two-week rule without due date"
TWO_WEEK_TEXT_PASS = "Pour is at least 14 days before due"
TWO_WEEK_TEXT_EXCEPTION = "Due is already inside 14 days; poured at earliest feasible slot"
TWO_WEEK_TEXT_VIOLATION = "Pour is inside 14-day window even though due runway exists"
NOT_YET_SCHEDULED = "Not Yet Scheduled"
PARTIALLY_SCHEDULED = "Partially Scheduled"
SCHEDULED = "Scheduled"


def risk_status(buffer_days) -> Column:
    b = col_(buffer_days)
    return (F.when(b.isNull(), UNKNOWN).when(b < RISK_AT_RISK_BELOW_DAYS, AT_RISK)
            .when(b < RISK_WATCH_BELOW_DAYS, WATCH).otherwise(ON_TRACK))


def risk_diagnostic(buffer_days) -> Column:
    b = col_(buffer_days)
    return (F.when(b.isNull(), RISK_TEXT_UNKNOWN).when(b < RISK_AT_RISK_BELOW_DAYS, RISK_TEXT_AT_RISK)
            .when(b < RISK_WATCH_BELOW_DAYS, RISK_TEXT_WATCH).otherwise(RISK_TEXT_ON_TRACK))


def _two_week(buffer_days, min_days_until_due, texts):
    b, m = col_(buffer_days), col_(min_days_until_due)
    return (F.when(b.isNull(), texts[0]).when(b >= TARGET_POUR_LEAD_DAYS, texts[1])
            .when(m.isNotNull() & (m < TARGET_POUR_LEAD_DAYS), texts[2]).otherwise(texts[3]))


def two_week_status(buffer_days, min_days_until_due) -> Column:
    return _two_week(buffer_days, min_days_until_due,
                     (UNKNOWN, TWO_WEEK_PASS, TWO_WEEK_EXCEPTION, TWO_WEEK_VIOLATION))


def two_week_note(buffer_days, min_days_until_due) -> Column:
    return _two_week(buffer_days, min_days_until_due,
                     (TWO_WEEK_TEXT_UNKNOWN, TWO_WEEK_TEXT_PASS, TWO_WEEK_TEXT_EXCEPTION,
                      TWO_WEEK_TEXT_VIOLATION))


def schedule_status(planned, scheduled) -> Column:
    p, s = F.coalesce(col_(planned), F.lit(0)), F.coalesce(col_(scheduled), F.lit(0))
    return (F.when(s <= 0, NOT_YET_SCHEDULED).when(s < p, PARTIALLY_SCHEDULED)
            .otherwise(SCHEDULED))


def on_time_status(status, ship_buffer_days) -> Column:
    st, b = col_(status), col_(ship_buffer_days)
    return (F.when(st == NOT_YET_SCHEDULED, "NOT SCHEDULED").when(b.isNull(), UNKNOWN)
            .when(b >= 0, "YES").otherwise("NO"))


# Colour bands are returned as category words instead of cell fills.
def ship_buffer_band(b) -> Column:
    b = col_(b)
    return (F.when(b.isNull(), "gray").when(b < 0, "red")
            .when(b < SHIP_BUFFER_TIGHT_BELOW_DAYS, "yellow").otherwise("green"))


def status_band(status) -> Column:
    s = F.upper(F.trim(col_(status)))
    return (F.when(s == "SCHEDULED", "green").when(s == "PARTIALLY SCHEDULED", "yellow")
            .when(s == "NOT YET SCHEDULED", "orange"))


def on_time_band(on_time) -> Column:
    s = F.upper(F.trim(col_(on_time)))
    return (F.when(s == "YES", "green").when(s == "NO", "red")
            .when(s == "NOT SCHEDULED", "orange").otherwise("gray"))


def two_week_band(status) -> Column:
    s = F.upper(F.trim(col_(status)))
    return (F.when(s == "PASS", "green").when(s == "EXCEPTION - NO TIME", "yellow")
            .when(s == "VIOLATION", "red").otherwise("gray"))


def due_buffer_band(status) -> Column:
    s = F.upper(F.trim(col_(status)))
    return (F.when(s == "ON TRACK", "green").when(s == "WATCH", "yellow")
            .when(s == "AT RISK", "red").otherwise("gray"))


def capacity_label(prefix: str, used, limit) -> Column:
    """``L=12/30`` style label."""
    return F.format_string(f"{prefix}=%d/%d", col_(used).cast("long"), F.lit(limit).cast("long")
                           if not isinstance(limit, Column) else limit.cast("long"))


def job_label(job, ext) -> Column:
    """``job-ext`` when both present, else the job."""
    j = F.coalesce(F.trim(col_(job)), F.lit(""))
    e = F.coalesce(F.trim(col_(ext)), F.lit(""))
    return F.when((j != "") & (e != ""), F.concat_ws("-", j, e)).otherwise(j)


def breakout_text(job, ext, due, molds) -> Column:
    """``job-ext | Due MM/dd/yyyy | Molds n``."""
    return F.format_string("%s | Due %s | Molds %s", job_label(job, ext),
                           F.coalesce(F.date_format(col_(due), "MM/dd/yyyy"), F.lit("")),
                           F.coalesce(col_(molds).cast("long").cast("string"), F.lit("")))
