"""Therapist dashboard for every therapist at once."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlour.functions.joins import top_k_per_group
from parlour.functions.ranking import global_rank_lag_lead
from parlour.functions.temporal import (as_datetime, duration_micros, employed, period_starts, role_active, today,
                                        ts_lit)
from parlour.sources.schemas import MONEY

DONE = ("completed", "paid")
# Role-type keywords of the leaderboard, and the bonus line.
LEADERBOARD_ROLES = ("therapist", "beautician", "doctor")
BONUS_TARGET = 8000.0
BONUS_DONE = "Bonus Achieved! 🎉"


def _net() -> F.Column:
    return F.col("cost") - F.col("item_discount")


def jobs_on_day(t: dict[str, DataFrame], as_of) -> DataFrame:
    """Ended items started today or yesterday, per therapist, with service and customer.

    The day test is a range on actual_start (not a cast), so it can reach the scan."""
    d0 = period_starts(as_of)["today"]
    days = {"today": (d0, d0 + timedelta(days=1)), "yesterday": (d0 - timedelta(days=1), d0)}
    ti = t["transaction_items"].where(
        F.col("actual_end").isNotNull() & (F.col("actual_start") >= ts_lit(days["yesterday"][0]))
        & (F.col("actual_start") < ts_lit(days["today"][1])))
    day = F.when(F.col("actual_start") >= ts_lit(d0), "today").otherwise("yesterday")
    j = (ti.join(t["services"].select("sid", F.col("name").alias("service_name")), "sid")
         .join(t["transactions"].select("tid", "cid"), "tid")
         .join(t["customers"].select("cid", F.col("name").alias("customer_name")), "cid"))
    return j.select(
        day.alias("day"), F.col("therapist_eid").alias("eid"), "ttid", "service_name", _net().alias("final_cost"),
        "actual_start", "actual_end",
        F.floor(duration_micros(F.col("actual_start"), F.col("actual_end")) / 60_000_000).alias("minutes"),
        "cid", "customer_name")


def therapist_period_stats(t: dict[str, DataFrame], as_of) -> DataFrame:
    """Per employee, items and net revenue today / week / month / year to date
    (completed or paid invoices). Week, month and ytd have no upper bound; zero rows kept."""
    st = period_starts(as_of)
    d1 = st["today"] + timedelta(days=1)
    ti = t["transaction_items"].where(F.col("actual_start") >= ts_lit(min(st.values())))
    ti = ti.join(t["transactions"].where(F.col("status").isin(*DONE)).select("tid"), "tid", "left_semi")
    a = F.col("actual_start")
    flags = {"today": (a >= ts_lit(st["today"])) & (a < ts_lit(d1)), "week": a >= ts_lit(st["week"]),
             "month": a >= ts_lit(st["month"]), "ytd": a >= ts_lit(st["year"])}
    aggs = []
    for p, f in flags.items():
        aggs += [F.count_if(f).alias(f"{p}_count"), F.sum(F.when(f, _net())).alias(f"{p}_revenue")]
    per = ti.groupBy(F.col("therapist_eid").alias("eid")).agg(*aggs)
    out = t["employees"].select("eid").join(per, "eid", "left")
    cols = ["eid"]
    for p in flags:
        cols += [F.coalesce(f"{p}_count", F.lit(0)).alias(f"{p}_count"),
                 F.coalesce(f"{p}_revenue", F.lit(0).cast(MONEY)).alias(f"{p}_revenue")]
    return out.select(*cols)


def _board(t: dict[str, DataFrame], as_of) -> DataFrame:
    """(eid, work_name, n_roles) of the employees on the board: one row each."""
    d = today(as_of)
    e = t["employees"].where(employed(F.col("employment_end"), d, inclusive=True)).select("eid", "work_name")
    rd = t["role_definition"].where(F.greatest(*[F.lower("role_type").contains(k) for k in LEADERBOARD_ROLES]))
    r = t["roles"].where(role_active(F.col("start_date"), F.col("end_date"), d)).join(rd, "rdid", "left_semi")
    return e.join(r.groupBy("eid").agg(F.count(F.lit(1)).alias("n_roles")), "eid")


def therapist_revenue(t: dict[str, DataFrame], as_of, dedupe_roles: bool = False) -> DataFrame:
    """Month-to-date revenue of ended items per employee holding a therapist/beautician/doctor
    role, zero kept. As in the reference an employee with two such roles counts twice, and the
    invoice status is not applied; ``dedupe_roles=True`` counts each employee once."""
    ti = t["transaction_items"].where(
        (F.col("actual_start") >= ts_lit(period_starts(as_of)["month"])) & F.col("actual_end").isNotNull())
    # aggregate items first (one row per therapist), then multiply by the role fan-out
    per = ti.groupBy(F.col("therapist_eid").alias("eid")).agg(F.sum(_net()).alias("rev"))
    n_roles = F.lit(1).cast("long") if dedupe_roles else F.col("n_roles")
    return _board(t, as_of).join(per, "eid", "left").select("eid", "work_name",
                    (F.coalesce("rev", F.lit(0).cast(MONEY)) * n_roles).cast("decimal(24,2)").alias("revenue"))


def leaderboard(t: dict[str, DataFrame], as_of, dedupe_roles: bool = False) -> DataFrame:
    """RANK, LAG, LEAD, FIRST_VALUE by revenue DESC and the field size, for every
    employee on the board (LAG/LEAD ties broken by eid).

    The input is one row per employee (already aggregated). Leader revenue and field size
    are plain aggregates joined back as one broadcast row; rank/lag/lead come from a
    range-partitioned global order (:mod:`parlour.functions.ranking`), not a one-task window.
    """
    rev = therapist_revenue(t, as_of, dedupe_roles)
    stats = rev.agg(F.max("revenue").alias("leader_revenue"), F.count(F.lit(1)).alias("total_therapists"))
    ranked = global_rank_lag_lead(rev, "revenue", "eid").select(
        "eid", "work_name", "revenue", "rank", F.col("above").alias("person_above_revenue"),
        F.col("below").alias("person_below_revenue"))
    return ranked.crossJoin(F.broadcast(stats))


def leaderboard_gaps(t: dict[str, DataFrame], as_of, dedupe_roles: bool = False) -> DataFrame:
    """T4: the dashboard's gap arithmetic over T3, in floating point as the reference does.
    A neighbour with zero revenue counts as no neighbour."""
    lb = leaderboard(t, as_of, dedupe_roles)
    rev = F.col("revenue").cast("double")
    above = F.nullif(F.col("person_above_revenue").cast("double"), F.lit(0.0))
    below = F.nullif(F.col("person_below_revenue").cast("double"), F.lit(0.0))
    gap8k = F.lit(BONUS_TARGET) - rev
    board = lb.select(
        "eid", "work_name", rev.alias("revenue"), "rank", "total_therapists",
        F.col("leader_revenue").cast("double").alias("leader_revenue"),
        (F.col("leader_revenue").cast("double") - rev).alias("gap_to_leader"),
        above.alias("person_above_revenue"), F.coalesce(rev - above, F.lit(0.0)).alias("gap_from_above"),
        below.alias("person_below_revenue"), F.coalesce(below - rev, F.lit(0.0)).alias("gap_to_next"),
        gap8k.alias("gap_from_8k"),
        F.when(rev >= BONUS_TARGET, F.lit(BONUS_DONE))
        .otherwise(F.format_string("Needs $%.2f more", gap8k)).alias("bonus_status"),
        (F.col("rank") == 1).alias("is_leader"))
    # fixed values: what an employee who is not on the board sees
    absent = t["employees"].select("eid", "work_name").join(_board(t, as_of).select("eid"), "eid", "left_anti")
    zero, none, n = F.lit(0.0), F.lit(None).cast("double"), F.lit(0).cast("long")
    return board.unionByName(absent.select(
        "eid", "work_name", zero.alias("revenue"), n.alias("rank"), n.alias("total_therapists"), zero.alias("leader_revenue"),
        zero.alias("gap_to_leader"), none.alias("person_above_revenue"), zero.alias("gap_from_above"),
        none.alias("person_below_revenue"), zero.alias("gap_to_next"), F.lit(BONUS_TARGET).cast("double").alias("gap_from_8k"),
        F.lit("Needs $8000.00 more").alias("bonus_status"), F.lit(False).alias("is_leader")))


def top_customers(t: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """T5: per therapist, the ``k`` customers with the highest net spend on ended items of
    completed/paid invoices: spend, visits, last visit, spend per visit, minutes per item."""
    ti = t["transaction_items"].where(F.col("actual_start").isNotNull() & F.col("actual_end").isNotNull())
    tx = t["transactions"].where(F.col("status").isin(*DONE)).select("tid", "cid")
    j = ti.join(tx, "tid")
    micros = duration_micros(F.col("actual_start"), F.col("actual_end"))
    per = j.groupBy(F.col("therapist_eid").alias("eid"), "cid").agg(
        F.sum(_net()).alias("total_spend"), F.count_distinct("tid").alias("total_visits"),
        F.max("actual_end").alias("last_visit_date"), F.sum(micros).alias("_micros"), F.count(F.lit(1)).alias("_n"))
    top = top_k_per_group(per, ["eid"], [F.desc("total_spend"), F.asc("cid")], k)
    top = top.join(t["customers"].select("cid", "name"), "cid")
    return top.select(
        "eid", "rn", "cid", "name", "total_spend", "total_visits", "last_visit_date",
        (F.col("total_spend").cast("double") / F.col("total_visits")).alias("avg_spend_per_visit"),
        (F.col("_micros").cast("double") / F.col("_n") / F.lit(60_000_000.0)).alias("avg_minutes_per_visit"))
