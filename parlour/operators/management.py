"""M1-M9: the management dashboard, every period in one pass.

The reference runs each report once per period (4 scans each). Here a report filters its
fact table to the widest period (year to date) once and then aggregates all four periods
together with conditional aggregates, so the scan and the shuffle happen once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlour.functions.temporal import PERIODS, as_datetime, duration_micros, period_starts, ts_lit
from parlour.sources.schemas import MONEY

DONE = ("completed", "paid")


def _net() -> F.Column:
    return F.col("cost") - F.col("item_discount")


def _period_flags(ts: F.Column, as_of) -> dict[str, F.Column]:
    now = ts_lit(as_datetime(as_of))
    return {p: (ts >= ts_lit(s)) & (ts < now) for p, s in period_starts(as_of).items()}


def _widest(ts: F.Column, as_of) -> F.Column:
    """From the earliest period start: in the first days of January the week began in December."""
    return (ts >= ts_lit(min(period_starts(as_of).values()))) & (ts < ts_lit(as_datetime(as_of)))


def _unpivot(row: DataFrame, metrics: list[str]) -> DataFrame:
    """One aggregated row with ``<period>__<metric>`` columns -> one row per period."""
    structs = [F.struct(F.lit(p).alias("period"), *[F.col(f"{p}__{m}").alias(m) for m in metrics]) for p in PERIODS]
    return row.select(F.inline(F.array(*structs)))


def service_counts(t: dict[str, DataFrame], as_of) -> DataFrame:
    """M2: items started in each period (no status filter); zero kept."""
    ti = t["transaction_items"].where(_widest(F.col("actual_start"), as_of)).select("tid", "actual_start")
    ti = ti.join(t["transactions"].select("tid"), "tid", "left_semi")
    flags = _period_flags(F.col("actual_start"), as_of)
    row = ti.agg(*[F.count_if(flags[p]).alias(f"{p}__service_count") for p in PERIODS])
    return _unpivot(row, ["service_count"])


def revenue(t: dict[str, DataFrame], as_of) -> DataFrame:
    """M3: payments received in each period; refunds are not subtracted."""
    p = t["payments"].where(_widest(F.col("payment_time"), as_of))
    flags = _period_flags(F.col("payment_time"), as_of)
    row = p.agg(*[F.coalesce(F.sum(F.when(flags[k], F.col("payment_amount"))), F.lit(0).cast(MONEY))
                  .alias(f"{k}__revenue") for k in PERIODS])
    return _unpivot(row, ["revenue"])


def payment_breakdown(t: dict[str, DataFrame], as_of) -> DataFrame:
    """M4: per period and method, the amount paid; methods without payments are absent.

    Each payment is tagged with the (up to four) periods it falls in and exploded, which is a
    narrow transformation: no range join against the period table is needed.
    """
    p = t["payments"].where(_widest(F.col("payment_time"), as_of)).join(
        t["transactions"].select("tid"), "tid", "left_semi")
    flags = _period_flags(F.col("payment_time"), as_of)
    tags = F.array_compact(F.array(*[F.when(flags[k], F.lit(k)) for k in PERIODS]))
    x = p.select(F.explode(tags).alias("period"), "payment_method", "payment_amount")
    return x.groupBy("period", "payment_method").agg(F.sum("payment_amount").alias("total"))


def top_therapists_mtd(t: dict[str, DataFrame], as_of, k: int = 5) -> DataFrame:
    """M5: month-to-date item count and net revenue per employee; top ``k`` by revenue (tie: eid)."""
    start = period_starts(as_of)["month"]
    ti = t["transaction_items"].where(
        (F.col("actual_start") >= ts_lit(start)) & (F.col("actual_start") < ts_lit(as_datetime(as_of))))
    ti = ti.join(t["transactions"].select("tid"), "tid", "left_semi")
    agg = ti.groupBy(F.col("therapist_eid").alias("eid")).agg(
        F.count("ttid").alias("service_count"), F.coalesce(F.sum(_net()), F.lit(0).cast(MONEY)).alias("revenue"))
    j = agg.join(t["employees"].select("eid", "work_name"), "eid")
    return j.orderBy(F.desc("revenue"), F.asc("eid")).limit(k).select("eid", "work_name", "service_count", "revenue")


def room_utilization(t: dict[str, DataFrame], k: int = 3) -> DataFrame:
    """M6: bookings and net revenue per room over all time, unused rooms kept with 0; of the list by
    bookings DESC, rid the first ``k`` (most used) and the last ``k`` (least used), both in list order."""
    per_room = t["transaction_items"].groupBy("rid").agg(F.count("ttid").alias("bookings"), F.sum(_net()).alias("rev"))
    j = t["room"].join(per_room, "rid", "left").select(
        "rid", "room_name", F.coalesce("bookings", F.lit(0)).alias("bookings"),
        F.coalesce("rev", F.lit(0).cast(MONEY)).alias("revenue"))
    # two distributed top-k; the windows then see k rows each
    ends = {"most_used": j.orderBy(F.desc("bookings"), F.asc("rid")).limit(k),
            "least_used": j.orderBy(F.asc("bookings"), F.desc("rid")).limit(k)}
    pos = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("bookings"), F.asc("rid"))).cast("long")
    most, least = (d.withColumn("list", F.lit(name)) for name, d in ends.items())
    return most.unionByName(least).select("list", pos.alias("pos"), "rid", "room_name", "bookings", "revenue")


def avg_spend_per_visit(t: dict[str, DataFrame], as_of) -> DataFrame:
    """M7: per period, the average invoice total (items, completed/paid, by created_at) and visits."""
    tx = t["transactions"].where(_widest(F.col("created_at"), as_of) & F.col("status").isin(*DONE)).select(
        "tid", "created_at")
    wanted = t["transaction_items"].join(tx.select("tid"), "tid", "left_semi")
    j = tx.join(wanted.groupBy("tid").agg(F.sum(_net()).alias("total")), "tid")
    flags = _period_flags(F.col("created_at"), as_of)
    aggs = []
    for p in PERIODS:
        n = F.count_if(flags[p])
        s = F.sum(F.when(flags[p], F.col("total")))
        aggs += [F.coalesce(s.cast("double") / n, F.lit(0.0)).alias(f"{p}__avg_spend_per_visit"),
                 n.alias(f"{p}__total_visits")]
    return _unpivot(j.agg(*aggs), ["avg_spend_per_visit", "total_visits"])


def avg_service_minutes(t: dict[str, DataFrame], as_of) -> DataFrame:
    """M8: per period, the average actual service length in minutes and the count."""
    ti = t["transaction_items"].where(
        F.col("actual_start").isNotNull() & F.col("actual_end").isNotNull() & _widest(F.col("actual_start"), as_of))
    ti = ti.join(t["transactions"].where(F.col("status").isin(*DONE)).select("tid"), "tid", "left_semi")
    micros = duration_micros(F.col("actual_start"), F.col("actual_end"))
    flags = _period_flags(F.col("actual_start"), as_of)
    aggs = []
    for p in PERIODS:
        n = F.count_if(flags[p])
        mean = F.sum(F.when(flags[p], micros)).cast("double") / n / F.lit(60_000_000.0)
        aggs += [F.coalesce(mean, F.lit(0.0)).alias(f"{p}__avg_duration_minutes"),
                 F.count_if(flags[p]).alias(f"{p}__completed_services")]
    return _unpivot(ti.agg(*aggs), ["avg_duration_minutes", "completed_services"])


def last_month(as_of) -> tuple[datetime, datetime]:
    this = period_starts(as_of)["month"]
    prev = datetime(this.year - 1, 12, 1) if this.month == 1 else datetime(this.year, this.month - 1, 1)
    return prev, this


def high_spenders(t: dict[str, DataFrame], as_of, factor: float = 1.30) -> DataFrame:
    """M9: last calendar month's customers spending at least ``factor`` x the average.

    The per-customer totals are computed once and used twice (average and filter); the
    average is a one-row aggregate, so the cross join is with a single broadcast row.
    """
    lo, hi = last_month(as_of)
    ti = t["transaction_items"].where((F.col("actual_start") >= ts_lit(lo)) & (F.col("actual_start") < ts_lit(hi)))
    tx = t["transactions"].where(F.col("status").isin(*DONE)).select("tid", "cid")
    per_tid = ti.groupBy("tid").agg(F.sum(_net()).alias("tid_total"))  # pre-aggregate before the join
    j = per_tid.join(tx, "tid").join(t["customers"].select("cid"), "cid", "left_semi")
    per_cust = j.groupBy("cid").agg(F.sum("tid_total").alias("total_spent"), F.count("tid").alias("visit_count"))
    avg = per_cust.agg((F.sum("total_spent").cast("double") / F.count(F.lit(1))).alias("last_month_average"))
    top = per_cust.where(F.col("total_spent") > 0).crossJoin(F.broadcast(avg)).where(
        F.col("total_spent").cast("double") >= F.col("last_month_average") * factor)
    top = top.join(t["customers"].select("cid", "name", "mobile_number"), "cid")
    return top.select(
        "cid", "name", "mobile_number", "total_spent", "visit_count",
        F.round(F.col("total_spent") / F.col("visit_count"), 2).alias("avg_per_visit"),
        "last_month_average",
        F.round((F.col("total_spent").cast("double") - F.col("last_month_average")) / F.col("last_month_average") * 100, 1)
        .alias("percent_above_average"))
