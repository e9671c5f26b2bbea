"""Dates: status of a period, days left, month grid. The day that counts as today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts: Column, zone: str | None = None) -> Column:
    """Calendar day of an instant, in a zone if one is given."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone) if zone else ts)


def period_status(start: Column, end: Column, as_of: Column) -> Column:
    """scheduled before the start, closed after the end, open between; null without either."""
    return (
        F.when(start.isNull() & end.isNull(), F.lit(None).cast("string"))
        .when(start.isNotNull() & (as_of < start), "scheduled")
        .when(end.isNotNull() & (as_of > end), "closed")
        .otherwise("open")
    )


def days_left(end: Column, as_of: Column) -> Column:
    return F.datediff(end, as_of).cast("long")


def deadline_kind(end: Column, as_of: Column, soon: int = 7) -> Column:
    """unknown, past, today, imminent (``soon`` days at most) or upcoming."""
    n = days_left(end, as_of)
    return F.when(end.isNull(), "unknown").when(n < 0, "past").when(n == 0, "today").when(n <= soon, "imminent").otherwise("upcoming")


def month_grid(month: Column) -> Column:
    """42 days from the Sunday on or before the first of the month."""
    first = F.trunc(month, "month")
    sunday = F.date_sub(first, F.dayofweek(first) - 1)
    return F.sequence(sunday, F.date_add(sunday, 41))
