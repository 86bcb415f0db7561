"""Management dashboard queries (M2-M9) and their oracles."""

from __future__ import annotations

from parlour.operators import management as m
from parlour.plans.registry import register
from parlour.plans.tables import AS_OF, tables

NOW = f"TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'"
PERIOD = f"""period AS (SELECT unnest(['today', 'week', 'month', 'year']) AS period,
  unnest([date_trunc('day', {NOW}), date_trunc('week', {NOW}), date_trunc('month', {NOW}), date_trunc('year', {NOW})]) AS since)"""
INVOICE = "invoice AS (SELECT tid, SUM(cost) - SUM(item_discount) AS total FROM transaction_items GROUP BY tid)"
DONE = "SELECT tid FROM transactions WHERE status = 'completed' OR status = 'paid'"

register("service_counts", f"""WITH {PERIOD}
SELECT period, (SELECT COUNT(*) FROM transaction_items WHERE actual_start >= since AND actual_start < {NOW}
                AND tid IN (SELECT tid FROM transactions)) AS service_count FROM period""")(lambda s, d: m.service_counts(tables(s, d), AS_OF))

register("revenue", f"""WITH {PERIOD}
SELECT period, CAST(COALESCE((SELECT SUM(payment_amount) FROM payments WHERE payment_time >= since AND payment_time < {NOW}), 0) AS DOUBLE) AS revenue
FROM period""")(lambda s, d: m.revenue(tables(s, d), AS_OF))

register("payment_breakdown", f"""WITH {PERIOD}
SELECT period, payment_method, CAST(SUM(payment_amount) AS DOUBLE) AS total
FROM period JOIN payments ON payment_time >= since AND payment_time < {NOW} GROUP BY ALL""")(
    lambda s, d: m.payment_breakdown(tables(s, d), AS_OF))

register("top_therapists_mtd", f"""
WITH month AS (SELECT therapist_eid AS eid, COUNT(*) AS n, SUM(cost) - SUM(item_discount) AS net FROM transaction_items
               WHERE date_trunc('month', actual_start) = date_trunc('month', {NOW}) AND actual_start < {NOW} GROUP BY therapist_eid)
SELECT eid, (SELECT work_name FROM employees e WHERE e.eid = month.eid) AS work_name, n AS service_count, CAST(net AS DOUBLE) AS revenue
FROM month WHERE (SELECT COUNT(*) FROM month o WHERE o.net > month.net OR o.net = month.net AND o.eid < month.eid) < 5""")(
    lambda s, d: m.top_therapists_mtd(tables(s, d), AS_OF))

register("room_utilization", """
WITH used AS (SELECT rid, room_name, (SELECT COUNT(*) FROM transaction_items i WHERE i.rid = room.rid) AS bookings,
                CAST(COALESCE((SELECT SUM(cost) - SUM(item_discount) FROM transaction_items i WHERE i.rid = room.rid), 0) AS DOUBLE) AS revenue FROM room),
placed AS (SELECT *, (SELECT COUNT(*) FROM used o WHERE o.bookings > u.bookings OR o.bookings = u.bookings AND o.rid <= u.rid) AS place FROM used u),
n AS (SELECT GREATEST(COUNT(*) - 3, 0) AS before_last FROM room)
SELECT 'most_used' AS list, place AS pos, rid, room_name, bookings, revenue FROM placed WHERE place <= 3
UNION ALL SELECT 'least_used', place - before_last, rid, room_name, bookings, revenue FROM placed, n WHERE place > before_last""")(
    lambda s, d: m.room_utilization(tables(s, d)))

register("avg_spend_per_visit", f"""WITH {PERIOD}, {INVOICE},
visit AS (SELECT created_at, total FROM invoice JOIN transactions USING (tid) WHERE tid IN ({DONE}) AND created_at < {NOW})
SELECT period, COALESCE(CAST(SUM(total) AS DOUBLE) / COUNT(total), 0) AS avg_spend_per_visit, COUNT(total) AS total_visits
FROM period LEFT JOIN visit ON created_at >= since GROUP BY period""")(lambda s, d: m.avg_spend_per_visit(tables(s, d), AS_OF))

register("avg_service_minutes", f"""WITH {PERIOD},
served AS (SELECT actual_start, epoch_us(actual_end) - epoch_us(actual_start) AS us FROM transaction_items
           WHERE actual_end IS NOT NULL AND actual_start < {NOW} AND tid IN ({DONE}))
SELECT period, COALESCE(CAST(SUM(us) AS DOUBLE) / COUNT(us) / 60000000.0, 0) AS avg_duration_minutes, COUNT(us) AS completed_services
FROM period LEFT JOIN served ON actual_start >= since GROUP BY period""")(lambda s, d: m.avg_service_minutes(tables(s, d), AS_OF))

HIGH_SPENDERS_SQL = f"""
WITH visit AS (SELECT tid, SUM(cost) - SUM(item_discount) AS net FROM transaction_items
               WHERE date_trunc('month', actual_start) = date_trunc('month', {NOW}) - INTERVAL '1' MONTH AND tid IN ({DONE}) GROUP BY tid),
spender AS (SELECT cid, SUM(net) AS total, COUNT(*) AS n FROM visit JOIN transactions USING (tid) WHERE cid IN (SELECT cid FROM customers) GROUP BY cid),
mean AS (SELECT CAST(SUM(total) AS DOUBLE) / COUNT(*) AS mean FROM spender)
SELECT cid, name, mobile_number, CAST(total AS DOUBLE) AS total_spent, n AS visit_count,
       -- exact HALF_UP rounding of the decimal quotient, in cents
       CAST((CAST(total * 100 AS BIGINT) * 2 + n) // (2 * n) AS DOUBLE) / 100 AS avg_per_visit, mean AS last_month_average,
       ROUND((CAST(total AS DOUBLE) - mean) / mean * 100, 1) AS percent_above_average
FROM spender JOIN customers USING (cid), mean WHERE total > 0 AND CAST(total AS DOUBLE) >= mean * 1.30"""

register("high_spenders", HIGH_SPENDERS_SQL)(lambda s, d: m.high_spenders(tables(s, d), AS_OF))
