"""The order in which the reference lists its rows.

Its database puts NULLs last in ascending and first in descending order. Where its order leaves ties, the row's key
follows, so that a list comes out the same each time. A list for each of many customers, employees or search terms is
ordered by these first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of each list's order; a leading minus is descending.
ORDERS = {
    "active_transactions": ("-entry_time", "tid"),
    "staff_available_now": ("role_type", "work_name", "role_id"),
    "busy_now": ("scheduled_end", "ttid"),
    "working_now": ("scheduled_end", "ttid"),
    "therapists_free_of_work": ("work_name",),
    "invoices": ("cid", "-entry_time", "tid"),
    "jobs_on_day": ("eid", "-actual_start", "ttid"),
    "top_customers": ("eid", "rn"),
    "top_therapists_per_customer": ("cid", "rn"),
    "payment_breakdown": ("period", "-total", "payment_method"),
    "high_spenders": ("-total_spent", "cid"),
    "role_history": ("eid", "-start_date", "rid"),
    "service_catalog": ("name", "sid"),
    "search_employees": ("term_id", "work_name", "eid"),
    "search_customers_by_name": ("term_id", "name", "cid"),
    "search_customers_by_mobile": ("term_id", "name", "cid"),
    **{f"entry_exit_log_{p}": ("entry_time", "tid") for p in ("day", "week", "month", "3months", "6months")},
}


def in_order(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the order of the list ``name``; other results come as they are."""
    if name not in ORDERS:
        return df
    return df.orderBy(*[F.desc_nulls_first(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in ORDERS[name]])
