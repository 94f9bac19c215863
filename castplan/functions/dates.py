"""Date helpers: mixed ERP date decoding, business days, priority windows."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from castplan.functions.clean import col_
from castplan.schemas import (DAY_OFFSET_EPOCH, HIGHEST_PRIORITY_WINDOW_DAYS,
                              PRIORITY_REVIEW_WINDOW_DAYS, TARGET_POUR_LEAD_DAYS)

__all__ = [
    "decode_erp_date", "to_date_or_null", "priority_rank", "priority_label", "review_window",
    "days_until", "target_pour_date", "add_business_days", "weekday_name", "format_mdy",
    "date_range_text", "as_date_lit", "reference_date_or_today",
]


def as_date_lit(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def reference_date_or_today(d) -> _dt.date:
    """A reference date as a date; missing or unreadable means today."""
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    try:
        return _dt.date.fromisoformat(str(d).strip()[:10])
    except ValueError:
        return _dt.date.today()


def decode_erp_date(c) -> Column:
    """Decode one ERP date field: the first conversion that works of ISO text (a time may
    follow, junk may not), the first eight characters as ``yyyyMMdd``, and a whole number of
    days from the ERP epoch (also before it).  Anything else, and days that leave the years
    1 to 9999, is NULL.
    """
    x = F.trim(col_(c).cast("string"))
    iso = F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"),
                 F.substring(x, 1, 10).try_cast("date"))
    head = F.substring(x, 1, 8)
    # the cast reads yyyy-MM-dd many times faster than a pattern's formatter
    packed = F.when(head.rlike(r"^[0-9]{8}$"), F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)).try_cast("date"))
    epoch = _dt.date.fromisoformat(DAY_OFFSET_EPOCH)
    days = F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("int"))
    offset = F.when(days.between((_dt.date.min - epoch).days, (_dt.date.max - epoch).days), F.date_add(F.lit(epoch), days))
    return F.coalesce(iso, packed, offset)


def to_date_or_null(c) -> Column:
    """Normalise a date-like value to a DATE, NULL when it cannot be parsed."""
    return F.coalesce(col_(c).cast("string").try_cast("timestamp").cast("date"),
                      F.try_to_date(col_(c).cast("string"), "yyyy-MM-dd"))


def days_until(due, reference) -> Column:
    return F.datediff(col_(due), as_date_lit(reference))


def priority_rank(due, reference) -> Column:
    d = days_until(due, reference)
    return (F.when(d.isNull(), 2).when(d <= HIGHEST_PRIORITY_WINDOW_DAYS, 0)
            .when(d <= PRIORITY_REVIEW_WINDOW_DAYS, 1).otherwise(2))


def priority_label(rank) -> Column:
    r = col_(rank)
    return (F.when(r == 0, "Highest Priority").when(r == 1, "Priority Review")
            .otherwise("Standard"))


def review_window(rank) -> Column:
    r = col_(rank)
    return (F.when(r == 0, "Next 2 Weeks").when(r == 1, "Next 10 Weeks")
            .otherwise("Outside 10 Weeks"))


def target_pour_date(due, lead_days: int = TARGET_POUR_LEAD_DAYS) -> Column:
    return F.date_sub(col_(due), lead_days)


def add_business_days(start, n) -> Column:
    """Shift ``start`` by ``n`` weekdays (Saturday/Sunday skipped), closed form.

    Moving forward, a weekend start behaves like the Friday before it; moving back, like the
    Monday after it.  ``n = 0`` returns ``start`` unchanged.
    """
    s = col_(start)
    n = col_(n) if not isinstance(n, int) else F.lit(n)
    wd = F.weekday(s)  # Monday = 0 .. Sunday = 6
    fwd_base = F.when(wd >= 5, F.date_sub(s, wd - 4)).otherwise(s)
    fwd_wd = F.least(wd, F.lit(4))
    back_base = F.when(wd >= 5, F.date_add(s, 7 - wd)).otherwise(s)
    back_wd = F.when(wd >= 5, F.lit(0)).otherwise(wd)
    m = F.abs(n)
    weeks = F.floor(m / 5).cast("int")
    rem = (m % 5).cast("int")
    fwd = F.date_add(fwd_base, weeks * 7 + rem + F.when(fwd_wd + rem > 4, 2).otherwise(0))
    back = F.date_sub(back_base, weeks * 7 + rem + F.when(back_wd - rem < 0, 2).otherwise(0))
    return F.when(n == 0, s).when(n > 0, fwd).otherwise(back)


def weekday_name(d) -> Column:
    return F.date_format(col_(d), "EEEE")


def format_mdy(d) -> Column:
    return F.date_format(col_(d), "MM/dd/yyyy")


def date_range_text(first, last) -> Column:
    """``MM/dd/yyyy`` when one date, ``a - b`` for a range, NULL when no dates."""
    return (F.when(col_(first).isNull(), F.lit(None).cast("string"))
            .when(col_(first) == col_(last), format_mdy(first))
            .otherwise(F.concat_ws(" - ", format_mdy(first), format_mdy(last))))
