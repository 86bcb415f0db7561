"""The cashier's and manager's "right now" views, from one as_of instant.

All six read the same instant, so they are mutually consistent (the reference's cached
copies could be up to 30 minutes apart). Exclusions are anti joins, never collected lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlour.functions.temporal import covers, employed, role_active, today, ts_lit, duration_micros
from parlour.operators.derive import outstanding_col

OPEN = ("pending", "partial", "paid")


def _busy_items(t: dict[str, DataFrame], as_of) -> DataFrame:
    """Items whose schedule covers the instant (closed interval) and that have not ended."""
    now = ts_lit(as_of)
    return t["transaction_items"].where(
        covers(F.col("scheduled_start"), F.col("scheduled_end"), now) & F.col("actual_end").isNull())


def active_transactions(t: dict[str, DataFrame]) -> DataFrame:
    """L1: open invoices (pending/partial/paid, no exit) with customer, expected exit = latest
    scheduled end of their items, and what is still owed."""
    tx = t["transactions"].where(F.col("status").isin(*OPEN) & F.col("exit_time").isNull())
    exp = t["transaction_items"].join(tx.select("tid"), "tid", "left_semi").groupBy("tid").agg(F.max("scheduled_end").alias("expected_exit"))
    j = tx.join(t["customers"].select("cid", "name"), "cid").join(exp, "tid", "left")
    return j.select("tid", "cid", "name", "entry_time", "expected_exit",
                    outstanding_col(F.col("total_cost"), F.col("total_discount"), F.col("total_paid")).alias("outstanding"),
                    "status")


def staff_available_now(t: dict[str, DataFrame], as_of) -> DataFrame:
    """L2: one row per active role of every employed (inclusive) employee with no item in progress."""
    d = today(as_of)
    e = t["employees"].where(employed(F.col("employment_end"), d, inclusive=True)).select("eid", "work_name")
    r = t["roles"].where(role_active(F.col("start_date"), F.col("end_date"), d)).select(
        F.col("rid").alias("role_id"), "eid", "rdid")
    busy = _busy_items(t, as_of).select(F.col("therapist_eid").alias("eid"))
    j = e.join(r, "eid").join(t["role_definition"], "rdid").join(busy, "eid", "left_anti")
    return j.select("eid", "work_name", "role_id", "role_type")


def rooms_available_now(t: dict[str, DataFrame], as_of) -> DataFrame:
    """L3: rooms not used by any item in progress."""
    busy = _busy_items(t, as_of).select("rid")
    return t["room"].join(busy, "rid", "left_anti").select("rid", "room_name")


def _minutes_left(end: F.Column, as_of) -> F.Column:
    return duration_micros(ts_lit(as_of), end) / F.lit(60_000_000.0)


def busy_now(t: dict[str, DataFrame], as_of) -> DataFrame:
    """L4: items in progress with therapist, room, customer and fractional minutes left."""
    b = _busy_items(t, as_of).select("ttid", "tid", "therapist_eid", "rid", "scheduled_end")
    j = (b.join(t["employees"].select(F.col("eid").alias("therapist_eid"), "work_name"), "therapist_eid")
         .join(t["room"], "rid")
         .join(t["transactions"].select("tid", "cid"), "tid")
         .join(t["customers"].select("cid", F.col("name").alias("customer_name")), "cid"))
    return j.select("ttid", "work_name", "room_name", "customer_name", "scheduled_end",
                    _minutes_left(F.col("scheduled_end"), as_of).alias("minutes_left"))


def working_now(t: dict[str, DataFrame], as_of) -> DataFrame:
    """Items actually started, not ended, and not yet past their scheduled end."""
    ti = t["transaction_items"].where(
        F.col("actual_start").isNotNull() & F.col("actual_end").isNull() & (F.col("scheduled_end") > ts_lit(as_of)))
    j = (ti.join(t["employees"].select(F.col("eid").alias("therapist_eid"), "work_name"), "therapist_eid")
         .join(t["room"], "rid"))
    return j.select("ttid", "work_name", "room_name", "scheduled_end",
                    _minutes_left(F.col("scheduled_end"), as_of).alias("minutes_left"))


def therapists_free_of_work(t: dict[str, DataFrame], as_of) -> DataFrame:
    """Distinct work names of employed (exclusive) staff with an active '%therapist%' role
    and no item started and not ended (no time test, as in the reference)."""
    d = today(as_of)
    rd = t["role_definition"].where(F.lower("role_type").contains("therapist"))
    r = t["roles"].where(role_active(F.col("start_date"), F.col("end_date"), d)).join(rd, "rdid", "left_semi")
    e = t["employees"].where(employed(F.col("employment_end"), d, inclusive=False))
    started = t["transaction_items"].where(F.col("actual_start").isNotNull() & F.col("actual_end").isNull()).select(
        F.col("therapist_eid").alias("eid"))
    return e.join(r, "eid", "left_semi").join(started, "eid", "left_anti").select("work_name").distinct()
