"""L2-L4 for a table of instants instead of one: what was, or will be, going on at each of them, in one plan.

An item in progress at an instant covers it, both ends included. Instants are slots of a microsecond to either side, so
that the overlap join and the free sets of the slot searches serve here too; plain numbers come from one sweep over
starts, ends and instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlour.functions.bitmaps import member_sets, overlapping_sets, page_of
from parlour.functions.intervals import envelope_filter, time_overlap_pairs
from parlour.functions.temporal import duration_micros, employed
from parlour.operators.slots import SALTS, free_set_rows, free_sets


DAY_SALTS = 2  # parts to which a day's staff is sent: there are many days of few instants each


def _open_items(t: dict[str, DataFrame]) -> DataFrame:
    return t["transaction_items"].where(F.col("actual_end").isNull())


def _slots(instants: DataFrame) -> DataFrame:
    step = lambda n: F.timestamp_add("MICROSECOND", F.lit(n), F.col("at"))
    return instants.select("at", step(-1).alias("slot_start"), step(1).alias("slot_end")).where(F.col("at").isNotNull()).distinct()


def _at() -> F.Column:
    return F.timestamp_add("MICROSECOND", F.lit(1), F.col("slot_start")).alias("at")


def busy_at(t: dict[str, DataFrame], instants: DataFrame) -> DataFrame:
    """L4 at each of ``instants`` (at): the items in progress, where, for whom and how many minutes are left."""
    slots = _slots(instants)
    items = envelope_filter(_open_items(t), "scheduled_start", "scheduled_end", slots, "slot_start", "slot_end")
    items = items.where(F.col("scheduled_start") <= F.col("scheduled_end")).select("ttid", "tid", "therapist_eid", "rid", "scheduled_start", "scheduled_end")
    b = time_overlap_pairs(slots, items, ("slot_start", "slot_end"), ("scheduled_start", "scheduled_end"))
    j = (b.join(t["employees"].select(F.col("eid").alias("therapist_eid"), "work_name"), "therapist_eid").join(t["room"], "rid")
         .join(t["transactions"].select("tid", "cid"), "tid").join(t["customers"].select("cid", F.col("name").alias("customer_name")), "cid"))
    return j.select("at", "ttid", "work_name", "room_name", "customer_name", "scheduled_end",
                    (duration_micros(F.col("at"), F.col("scheduled_end")) / F.lit(60_000_000.0)).alias("minutes_left"))


def rooms_available_at(t: dict[str, DataFrame], instants: DataFrame) -> DataFrame:
    """L3 at each instant: (at, page, n_free, free), the rooms without an item in progress."""
    slots = _slots(instants).withColumn("cls", F.lit(0))
    rooms = t["room"].select(F.lit(0).alias("cls"), F.col("rid").alias("key"))
    return free_set_rows(free_sets(t, slots, member_sets(rooms), "rid")).select(_at(), "page", "n_free", "free")


def _instants_of(days: DataFrame) -> DataFrame:
    first = F.col("day").cast("timestamp_ntz")
    return days.select("day", first.alias("d0"), F.timestamp_add("MICROSECOND", F.lit(1), first).alias("d1"))


def _roles_cut(t: dict[str, DataFrame], days: DataFrame) -> DataFrame:
    """(eid, r0, r1) of the roles, cut to the days asked for, since an open end would put a role into the buckets of some 8,000 years."""
    env = days.agg(F.min("day").alias("_lo"), F.date_add(F.max("day"), 1).alias("_hi"))
    cut = t["roles"].crossJoin(F.broadcast(env)).select("eid", F.greatest("start_date", "_lo").alias("r0"), F.least(F.coalesce("end_date", "_hi"), "_hi").alias("r1"),
                                                        F.col("start_date").isNotNull().alias("_given")).where("_given AND r0 < r1")
    return cut.select("eid", F.col("r0").cast("timestamp_ntz").alias("r0"), F.col("r1").cast("timestamp_ntz").alias("r1"))


def staff_on_days(t: dict[str, DataFrame], days: DataFrame) -> DataFrame:
    """(day, eid) of those employed (to the last day) with an active role on each of ``days`` (day), a row each."""
    # the days go to the roles, as they are at most those of a calendar
    active = time_overlap_pairs(F.broadcast(_instants_of(days)), _roles_cut(t, days), ("d0", "d1"), ("r0", "r1")).select("day", "eid").distinct()
    e = t["employees"].select("eid", "employment_end")
    return active.join(e, "eid").where(employed(F.col("employment_end"), F.col("day"), inclusive=True)).select("day", "eid")


def staff_sets_on_days(t: dict[str, DataFrame], days: DataFrame) -> DataFrame:
    """``staff_on_days`` as bitmaps, (day, page, members): a row a day and page in place of one a day and employee."""
    over = F.date_add("employment_end", 1).cast("timestamp_ntz")
    spans = _roles_cut(t, days).join(t["employees"].select("eid", "employment_end"), "eid").select(
        F.col("eid").alias("key"), F.col("r0").alias("start"), F.least(F.col("r1"), over).alias("end")).where(F.col("start") < F.col("end"))
    pages = t["employees"].where(F.col("eid").isNotNull()).select(page_of(F.col("eid")).alias("page")).distinct()
    pages = pages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = _instants_of(days).withColumn("salt", F.pmod(F.xxhash64("day"), F.lit(SALTS)).cast("int")).join(pages, "salt")
    sets = overlapping_sets(asked.select(F.col("d0").alias("slot_start"), F.col("d1").alias("slot_end"), "page"), spans, "members")
    return sets.select(F.to_date("slot_start").alias("day"), "page", "members")


def staff_available_at(t: dict[str, DataFrame], instants: DataFrame) -> DataFrame:
    """L2 at each instant: (at, page, n_free, free), the employees on duty that day without an item in progress."""
    number = lambda day: F.datediff(day, F.lit("1970-01-01").cast("date"))
    slots = _slots(instants).withColumn("cls", number(F.to_date("at")))
    staff = staff_sets_on_days(t, slots.select(F.to_date("at").alias("day")).distinct())
    free = free_sets(t, slots, staff.select(number(F.col("day")).alias("cls"), "page", "members"), "therapist_eid", salts=DAY_SALTS)
    return free_set_rows(free).select(_at(), "page", "n_free", "free")


def busy_counts_at(t: dict[str, DataFrame], instants: DataFrame) -> DataFrame:
    """(at, in_progress): the number of items in progress at each instant, by a sweep: an item adds one from its start on and
    takes it off after its end. Sums run within the hour; what the hours before leave over is one row an hour."""
    items = _open_items(t).where(F.col("scheduled_start") <= F.col("scheduled_end"))
    over = F.timestamp_add("MICROSECOND", F.lit(1), F.col("scheduled_end"))
    step = F.explode(F.array(F.struct(F.col("scheduled_start").alias("at"), F.lit(1).alias("d")), F.struct(over.alias("at"), F.lit(-1).alias("d"))))
    steps = items.select(step.alias("s")).select("s.at", "s.d", F.lit(0).alias("asked"))
    asked = instants.where(F.col("at").isNotNull()).select("at").distinct().select("at", F.lit(0).alias("d"), F.lit(1).alias("asked"))
    hour = F.date_trunc("HOUR", F.col("at"))
    merged = steps.groupBy("at").agg(F.sum("d").alias("d"), F.lit(0).alias("asked")).unionByName(asked.withColumn("d", F.col("d").cast("long"))).withColumn("hour", hour)
    by_hour = merged.groupBy("hour").agg(F.sum("d").alias("d"))
    left_over = by_hour.select("hour", (F.sum("d").over(Window.orderBy("hour")) - F.col("d")).alias("before"))  # a row an hour
    within = F.sum("d").over(Window.partitionBy("hour").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0))
    return (merged.withColumn("within", within).where("asked = 1").join(left_over, "hour")
            .select("at", (F.col("before") + F.col("within")).alias("in_progress")))
