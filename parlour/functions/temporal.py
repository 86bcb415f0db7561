"""Time helpers: interval arithmetic, reporting periods, validity and overlap predicates.

All timestamps are ``timestamp_ntz``; ``as_of`` replaces the reference's ``NOW()`` /
``CURRENT_DATE`` and is always a parameter.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("today", "week", "month", "year")


def add_minutes(ts: Column, n) -> Column:
    return F.timestamp_add("MINUTE", n if isinstance(n, Column) else F.lit(n), ts)


def add_hours(ts: Column, n) -> Column:
    return F.timestamp_add("HOUR", n if isinstance(n, Column) else F.lit(n), ts)


def ts_lit(v: datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal. Built from text, so neither the Python process's zone nor the
    session zone can shift it."""
    v = v if isinstance(v, datetime) else datetime.fromisoformat(str(v))
    return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")


def as_datetime(as_of) -> datetime:
    return as_of if isinstance(as_of, datetime) else datetime.fromisoformat(str(as_of))


def today(as_of) -> date:
    return as_datetime(as_of).date()


def period_starts(as_of) -> dict[str, datetime]:
    """M1: start of today, of the ISO week (Monday), of the month and of the year."""
    now = as_datetime(as_of)
    d = datetime(now.year, now.month, now.day)
    return {
        "today": d,
        "week": d - timedelta(days=d.weekday()),
        "month": d.replace(day=1),
        "year": d.replace(month=1, day=1),
    }


def role_active(start_date: Column, end_date: Column, d) -> Column:
    """Role valid on day ``d``, half-open: start <= d and (end NULL or end > d)."""
    d = F.lit(d)
    return (start_date <= d) & (end_date.isNull() | (end_date > d))


def employed(employment_end: Column, d, inclusive: bool = True) -> Column:
    """Still employed on ``d``. The reference uses both ``end >= d`` and ``end > d``."""
    d = F.lit(d)
    return employment_end.isNull() | ((employment_end >= d) if inclusive else (employment_end > d))


def overlaps(start: Column, end: Column, slot_start: Column, slot_end: Column) -> Column:
    """Open-interval booking overlap: start < slot_end and end > slot_start."""
    return (start < slot_end) & (end > slot_start)


def covers(start: Column, end: Column, instant: Column) -> Column:
    """Closed 'right now' test of the live views: start <= now <= end."""
    return (start <= instant) & (end >= instant)


def duration_micros(a: Column, b: Column) -> Column:
    """(b - a) in whole microseconds (exact, so averages agree across engines)."""
    return F.timestamp_diff("MICROSECOND", a, b)
