"""K1-K5: customer dashboard and invoice detail for every customer at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlour.functions.joins import top_k_per_group
from parlour.operators.derive import outstanding_col

DONE = ("completed", "paid")


def top_therapists_per_customer(t: dict[str, DataFrame], k: int = 3) -> DataFrame:
    """K1: per customer the ``k`` therapists with most items on completed/paid invoices."""
    tx = t["transactions"].where(F.col("status").isin(*DONE)).select("tid", "cid")
    per = t["transaction_items"].select("tid", "therapist_eid").join(tx, "tid").groupBy(
        "cid", F.col("therapist_eid").alias("eid")).agg(F.count(F.lit(1)).alias("services_done"))
    top = top_k_per_group(per, ["cid"], [F.desc("services_done"), F.asc("eid")], k)
    return top.join(t["employees"].select("eid", "work_name"), "eid").select(
        "cid", "rn", "eid", "work_name", "services_done")


def last_therapist(t: dict[str, DataFrame]) -> DataFrame:
    """K2: per customer the most recently ended item (any status): therapist, end, service.
    Ties on the end time go to the highest ttid. ``max_by`` is a plain aggregate: partial
    aggregation keeps one row per customer per task before the shuffle."""
    ti = t["transaction_items"].where(F.col("actual_end").isNotNull()).select(
        "tid", "ttid", "sid", "therapist_eid", "actual_end")
    j = ti.join(t["transactions"].select("tid", "cid"), "tid")
    last = j.groupBy("cid").agg(F.max_by(F.struct("ttid", "sid", "therapist_eid", "actual_end"),
                                         F.struct("actual_end", "ttid")).alias("x"))
    last = last.select("cid", "x.ttid", "x.sid", F.col("x.therapist_eid").alias("eid"), "x.actual_end")
    return (last.join(t["employees"].select("eid", "work_name"), "eid")
            .join(t["services"].select("sid", F.col("name").alias("service_name")), "sid")
            .select("cid", "ttid", "eid", "work_name", "actual_end", "service_name"))


def invoices(t: dict[str, DataFrame]) -> DataFrame:
    """K3: every invoice with stored totals, net and status."""
    return t["transactions"].select(
        "cid", "tid", "entry_time", "total_cost", "total_discount",
        (F.col("total_cost") - F.col("total_discount")).alias("net"), "total_paid", "status")


def invoice_item_rows(t: dict[str, DataFrame]) -> DataFrame:
    """K4, flat: one row per invoice item with its invoice; an invoice without items keeps one
    row with NULL item columns."""
    items = (t["transaction_items"].select("tid", "ttid", "sid", "therapist_eid", "cost", "item_discount")
             .join(t["services"].select("sid", F.col("name").alias("service_name")), "sid")
             .join(t["employees"].select(F.col("eid").alias("therapist_eid"), "work_name"), "therapist_eid"))
    j = invoices(t).join(items, "tid", "left")
    return j.select("cid", "tid", "entry_time", "net", "status", "ttid", "service_name", "work_name", "cost",
                    "item_discount", (F.col("cost") - F.col("item_discount")).alias("item_net"))


def invoice_items(t: dict[str, DataFrame]) -> DataFrame:
    """K4, nested: per invoice the items as a sorted array of structs (empty when none).
    Items are grouped on ``tid`` before the join, replacing the reference's N+1 loop."""
    items = (t["transaction_items"].select("tid", "ttid", "sid", "therapist_eid", "cost", "item_discount")
             .join(t["services"].select("sid", F.col("name").alias("service_name")), "sid")
             .join(t["employees"].select(F.col("eid").alias("therapist_eid"), "work_name"), "therapist_eid"))
    per = items.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct(
        "ttid", "service_name", "work_name", "cost", "item_discount",
        (F.col("cost") - F.col("item_discount")).alias("net")))).alias("items"))
    j = invoices(t).join(per, "tid", "left")
    return j.withColumn("items", F.coalesce("items", F.array().cast(per.schema["items"].dataType)))


def transaction_detail(t: dict[str, DataFrame]) -> DataFrame:
    """K5: per invoice the header, items with room and clock (by scheduled start, items without one last), payments
    (latest first) and the outstanding amount; both lists are aggregated on ``tid`` first."""
    items = (t["transaction_items"].join(t["services"].select("sid", F.col("name").alias("service_name")), "sid")
             .join(t["employees"].select(F.col("eid").alias("therapist_eid"), "work_name"), "therapist_eid")
             .join(t["room"], "rid"))
    shown = ["ttid", "sid", "service_name", "therapist_eid", "work_name", "rid", "room_name", "scheduled_start", "scheduled_end", "actual_start",
             "actual_end", "cost", "item_discount", "item_discount_type"]
    in_order = F.sort_array(F.collect_list(F.struct(F.col("scheduled_start").isNull().alias("_last"), F.col("scheduled_start").alias("_at"), *shown)))
    item_list = items.groupBy("tid").agg(F.transform(in_order, lambda x: F.struct(*[x[c].alias(c) for c in shown])).alias("items"))
    pay_list = t["payments"].groupBy("tid").agg(F.sort_array(F.collect_list(F.struct(
        "payment_time", "pid", "payment_method", "payment_amount")), asc=False).alias("payments"))
    tx = t["transactions"].join(t["customers"].select("cid", "name", "mobile_number"), "cid")
    j = tx.join(item_list, "tid", "left").join(pay_list, "tid", "left")
    return j.select(
        "tid", "cid", "name", "mobile_number", "entry_time", "exit_time", "status", "total_cost", "total_discount", "total_paid",
        outstanding_col(F.col("total_cost"), F.col("total_discount"), F.col("total_paid")).alias("outstanding"),
        F.coalesce("items", F.array().cast(item_list.schema["items"].dataType)).alias("items"),
        F.coalesce("payments", F.array().cast(pay_list.schema["payments"].dataType)).alias("payments"))
