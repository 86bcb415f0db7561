"""The columns the reference keeps fresh with triggers, recomputed set-wise.

Every aggregate runs before its join (never join payments to items and then sum: fan-out),
and every per-invoice aggregate is a partial + final hash aggregate keyed on ``tid``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlour.functions.temporal import add_minutes, ts_lit
from parlour.sources.schemas import MONEY

OPEN_STATUSES = ("pending", "partial", "paid")


def _zero() -> F.Column:
    return F.lit(0).cast(MONEY)


def scheduled_end(t: dict[str, DataFrame]) -> DataFrame:
    """scheduled_end = scheduled_start + service duration; kept as given when start is NULL."""
    ti = t["transaction_items"]
    s = t["services"].select("sid", "duration_minutes")
    j = ti.join(s, "sid", "left")
    return j.select(
        "ttid", "tid", "sid", "scheduled_start",
        F.when(F.col("scheduled_start").isNotNull(), add_minutes(F.col("scheduled_start"), F.col("duration_minutes")))
        .otherwise(F.col("scheduled_end")).alias("scheduled_end"))


def item_sums(t: dict[str, DataFrame]) -> DataFrame:
    return t["transaction_items"].groupBy("tid").agg(
        F.sum("cost").alias("items_cost"), F.sum("item_discount").alias("items_discount"))


def invoice_totals(t: dict[str, DataFrame]) -> DataFrame:
    """Per invoice, total_cost = sum(cost), total_discount = sum(item_discount) + bill discount."""
    tx = t["transactions"].select("tid", "billlevel_discount")
    j = tx.join(item_sums(t), "tid", "left")
    return j.select(
        "tid",
        F.coalesce(F.col("items_cost"), _zero()).cast(MONEY).alias("total_cost"),
        (F.coalesce(F.col("items_discount"), _zero()) + F.coalesce(F.col("billlevel_discount"), _zero()))
        .cast(MONEY).alias("total_discount"))


def billlevel_discount_change(t: dict[str, DataFrame], changes: DataFrame) -> DataFrame:
    """D3: apply ``changes(tid, billlevel_discount)``; total_discount follows the new value.

    Invoices without a change keep their discount; only changed invoices are returned.
    """
    items = t["transaction_items"].join(changes.select("tid"), "tid", "left_semi")  # no item of another invoice is summed
    j = changes.select("tid", F.col("billlevel_discount").cast(MONEY).alias("new_bill")).join(
        t["transactions"].select("tid"), "tid", "inner").join(item_sums({"transaction_items": items}), "tid", "left")
    return j.select(
        "tid", F.col("new_bill").alias("billlevel_discount"),
        (F.coalesce(F.col("items_discount"), _zero()) + F.coalesce(F.col("new_bill"), _zero())).cast(MONEY)
        .alias("total_discount"))


def net_paid(t: dict[str, DataFrame]) -> DataFrame:
    """total_paid = sum(payments) - sum(refunds), each 0 when absent."""
    paid = t["payments"].groupBy("tid").agg(F.sum("payment_amount").alias("paid"))
    refunded = t["refunds"].groupBy("tid").agg(F.sum("refund_amount").alias("refunded"))
    j = t["transactions"].select("tid").join(paid, "tid", "left").join(refunded, "tid", "left")
    return j.select(
        "tid", (F.coalesce("paid", _zero()) - F.coalesce("refunded", _zero())).cast(MONEY).alias("total_paid"))


def status_rule(status: F.Column, total_cost: F.Column, total_discount: F.Column, total_paid: F.Column) -> F.Column:
    """D5 as a column: the payment-state trigger. A NULL comparison falls through to 'paid'."""
    due = total_cost - total_discount
    return (F.when(~status.isin(*OPEN_STATUSES), status)
            .when(total_paid <= 0, "pending")
            .when(total_paid < due, "partial")
            .otherwise("paid"))


def recomputed(t: dict[str, DataFrame]) -> DataFrame:
    """Invoice headers with D2 and D4 recomputed from the line tables."""
    tx = t["transactions"].drop("total_cost", "total_discount", "total_paid")
    return tx.join(invoice_totals(t), "tid", "left").join(net_paid(t), "tid", "left")


def payment_status(t: dict[str, DataFrame]) -> DataFrame:
    """D5 over recomputed totals: per invoice the stored status and the one the trigger sets."""
    r = recomputed(t)
    return r.select(
        "tid", F.col("status").alias("old_status"), "total_cost", "total_discount", "total_paid",
        status_rule(F.col("status"), F.col("total_cost"), F.col("total_discount"), F.col("total_paid")).alias("status"))


def outstanding_col(total_cost: F.Column, total_discount: F.Column, total_paid: F.Column) -> F.Column:
    """greatest(0, cost - discount - paid); NULL when any part is NULL (as in SQL)."""
    return F.greatest(_zero(), total_cost - total_discount - total_paid)


def outstanding(t: dict[str, DataFrame]) -> DataFrame:
    """D7 on the stored totals."""
    tx = t["transactions"]
    return tx.select("tid", outstanding_col(F.col("total_cost"), F.col("total_discount"), F.col("total_paid"))
                     .alias("outstanding"))


def completion_rule(status: F.Column, outstanding_amt: F.Column, exit_time: F.Column) -> F.Column:
    """Completed once nothing is outstanding and the exit is recorded."""
    return F.when((outstanding_amt <= 0) & exit_time.isNotNull(), F.lit("completed")).otherwise(status)


def completion_status(t: dict[str, DataFrame], touched: DataFrame) -> DataFrame:
    """D6 after D5: status of the ``touched`` invoices (tid), those with a payment or exit event, once payments
    and exits are both accounted for. Without an event an invoice keeps its status."""
    r = recomputed({**t, "transactions": t["transactions"].join(touched.select("tid").distinct(), "tid", "left_semi")})
    st = status_rule(F.col("status"), F.col("total_cost"), F.col("total_discount"), F.col("total_paid"))
    out = outstanding_col(F.col("total_cost"), F.col("total_discount"), F.col("total_paid"))
    return r.select("tid", "exit_time", out.alias("outstanding"),
                    completion_rule(st, out, F.col("exit_time")).alias("status"))


def updated_at_stamp(before: DataFrame, after: DataFrame, key: str, as_of, columns: list[str]) -> DataFrame:
    """Rows of ``after`` whose ``columns`` differ (null-safe) from ``before`` get
    ``updated_at = as_of``; the others keep their stamp. ``before`` carries ``updated_at``."""
    b = before.select(key, "updated_at", *[F.col(c).alias(f"_old_{c}") for c in columns])
    j = after.join(b, key, "inner")
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return j.select(key, *columns, changed.alias("changed"),
                    F.when(changed, ts_lit(as_of)).otherwise(F.col("updated_at")).alias("updated_at"))
