"""The entry/exit compliance log."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlour.functions.temporal import duration_micros, ts_lit

# Period codes and their labels.
PERIOD_LABELS = {"day": "1 Day", "week": "1 Week", "month": "1 Month (30 days)", "3months": "3 Months",
                 "6months": "6 Months"}


def _add_months(d: date, n: int) -> date:
    y, m = divmod(d.month - 1 + n, 12)
    y, m = d.year + y, m + 1
    last = (date(y + (m == 12), m % 12 + 1, 1) - timedelta(days=1)).day
    return date(y, m, min(d.day, last))


def period_window(period: str, d: date, inclusive_end: bool = False) -> tuple[datetime, datetime, bool]:
    """(lo, hi, hi_inclusive) for a period starting on day ``d``. Unknown periods mean 'day'.

    3 and 6 months end at ``d + N months - 1 day`` at midnight, inclusive, so only the
    00:00:00 instant of the last day is in (as in the reference); ``inclusive_end`` keeps
    the whole last day instead."""
    lo = datetime(d.year, d.month, d.day)
    if period == "week":
        return lo, lo + timedelta(days=7), False
    if period == "month":
        return lo, lo + timedelta(days=30), False
    if period in ("3months", "6months"):
        last = _add_months(d, 3 if period == "3months" else 6) - timedelta(days=1)
        if inclusive_end:
            return lo, datetime(last.year, last.month, last.day) + timedelta(days=1), False
        return lo, datetime(last.year, last.month, last.day), True
    return lo, lo + timedelta(days=1), False


def entry_exit_log(t: dict[str, DataFrame], period: str, d: date, inclusive_end: bool = False) -> DataFrame:
    """Who entered in the period: name, id number, nationality, entry, exit (by entry)."""
    lo, hi, hi_incl = period_window(period, d, inclusive_end)
    e = F.col("entry_time")
    rng = (e >= ts_lit(lo)) & ((e <= ts_lit(hi)) if hi_incl else (e < ts_lit(hi)))
    tx = t["transactions"].where(e.isNotNull() & rng).select("tid", "cid", "entry_time", "exit_time")
    j = (tx.join(t["customers"].select("cid", "name", "nric_fin_passport_no", "country_code"), "cid")
         .join(t["nationcode"].select("country_code", "default_nationality"), "country_code"))
    return j.select("tid", "name", "nric_fin_passport_no", "default_nationality", "entry_time", "exit_time")


def stay_duration(log: DataFrame) -> DataFrame:
    """Display columns of the log: 'Hh Mm' of the stay, or '-' without an exit, and the
    exit shown as 'Still inside' when missing."""
    secs = F.floor(duration_micros(F.col("entry_time"), F.col("exit_time")) / 1_000_000)
    hm = F.format_string("%dh %dm", F.floor(secs / 3600), F.floor((secs % 3600) / 60))
    return log.select(
        "*",
        F.when(F.col("entry_time").isNotNull(), F.date_format("entry_time", "yyyy-MM-dd HH:mm"))
        .otherwise("-").alias("entry_display"),
        F.when(F.col("exit_time").isNotNull(), F.date_format("exit_time", "yyyy-MM-dd HH:mm"))
        .otherwise("Still inside").alias("exit_display"),
        F.when(F.col("exit_time").isNotNull() & F.col("entry_time").isNotNull(), hm).otherwise("-").alias("duration"))
