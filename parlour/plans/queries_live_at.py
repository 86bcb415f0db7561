"""The live views (L2-L4) for a table of instants, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlour.operators import live_at as la
from parlour.plans.registry import register
from parlour.plans.tables import tables
from parlour.sources.fixtures import read_raw


def instants(spark, sf_dir):
    """An instant for each order with o_orderkey % 40 = 1: half past an hour of its day, or the hour itself."""
    k = F.col("o_orderkey")
    minutes = (k % 24 * 60 + F.when(k % 3 == 0, 0).otherwise(30)).cast("int")
    return read_raw(spark, sf_dir)["orders"].where(k % 40 == 1).select(F.timestamp_add("MINUTE", minutes, F.col("o_orderdate").cast("timestamp_ntz")).alias("at"))


AT = """a AS (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24 * 60 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 30 END) * INTERVAL '1' MINUTE AS "at"
  FROM orders WHERE o_orderkey % 40 = 1),
b AS (SELECT "at", i.* FROM a JOIN transaction_items i ON "at" BETWEEN scheduled_start AND scheduled_end WHERE actual_end IS NULL)"""
OPEN = "DATE '9999-12-31'"

register("busy_at", f"""WITH {AT}
SELECT "at", ttid, work_name, room_name, c.name AS customer_name, scheduled_end, date_diff('microsecond', "at", scheduled_end) / 60000000.0::DOUBLE AS minutes_left
FROM b JOIN employees ON eid = therapist_eid JOIN room USING (rid) JOIN transactions t ON t.tid = b.tid JOIN customers c ON c.cid = t.cid""")(
    lambda s, d: la.busy_at(tables(s, d), instants(s, d)))


def _free_sql(on_duty: str, item_key: str) -> str:
    return f"""WITH {AT}, duty AS ({on_duty}),
f AS (SELECT "at", key FROM duty WHERE NOT EXISTS (FROM b WHERE b."at" = duty."at" AND b.{item_key} = key))
SELECT "at", CAST(page AS BIGINT) AS page, count(key) AS n_free, COALESCE(string_agg(key, ',' ORDER BY key), '') AS free
FROM (SELECT DISTINCT "at", key // 4096 AS page FROM duty) p LEFT JOIN (SELECT *, key // 4096 AS page FROM f) f USING ("at", page) GROUP BY ALL"""


register("rooms_available_at", _free_sql('SELECT "at", rid AS key FROM a, room', "rid"))(lambda s, d: la.rooms_available_at(tables(s, d), instants(s, d)))
register("staff_available_at", _free_sql(f"""SELECT DISTINCT "at", eid AS key FROM a, roles JOIN employees USING (eid)
  WHERE start_date <= CAST("at" AS DATE) AND COALESCE(end_date, {OPEN}) > CAST("at" AS DATE) AND COALESCE(employment_end, {OPEN}) >= CAST("at" AS DATE)""", "therapist_eid"))(
    lambda s, d: la.staff_available_at(tables(s, d), instants(s, d)))
register("busy_counts_at", f'''WITH {AT} SELECT a."at", count(ttid) AS in_progress FROM a LEFT JOIN b USING ("at") GROUP BY a."at"''')(
    lambda s, d: la.busy_counts_at(tables(s, d), instants(s, d)))
