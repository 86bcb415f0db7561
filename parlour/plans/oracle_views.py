"""The domain tables as DuckDB SQL over the driver tables (same rules as
:mod:`parlour.sources.fixtures`). ``with_views(sql)`` prefixes a query with them as CTEs;
DuckDB inlines the CTEs a query does not use away."""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "role_definition": """SELECT CAST(rdid AS INTEGER) AS rdid, role_type FROM (VALUES
        (0, 'Senior Therapist'), (1, 'Beautician'), (2, 'Doctor'), (3, 'Cashier'), (4, 'Manager')) v(rdid, role_type)""",
    "nationcode": """SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS country_code, n_name AS country_name,
        n_name AS default_nationality FROM nation""",
    "room": "SELECT CAST(n_nationkey AS INTEGER) AS rid, n_name AS room_name FROM nation",
    "customers": """SELECT c_custkey AS cid, 'S' || CAST(c_custkey AS VARCHAR) AS nric_fin_passport_no, c_name AS name,
        CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
        lpad(CAST((c_custkey * 7919) % 100000000 AS VARCHAR), 8, '0') AS mobile_number,
        lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS country_code FROM customer""",
    "employees": """SELECT s_suppkey AS eid, 'E' || CAST(s_suppkey AS VARCHAR) AS nric_fin_passport_no,
        replace(s_name, 'Supplier#', 'Staff ') AS name, s_name AS work_name,
        CASE WHEN s_suppkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
        lpad(CAST((s_suppkey * 7907) % 100000000 AS VARCHAR), 8, '0') AS mobile_number,
        lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS country_code, DATE '1995-01-01' AS employment_start,
        CASE WHEN s_suppkey % 9 = 4 THEN DATE '2000-06-14' WHEN s_suppkey % 9 = 7 THEN DATE '1999-12-31' END
          AS employment_end,
        TIMESTAMP '1995-01-01 09:00:00' AS created_at, TIMESTAMP '1995-01-01 09:00:00' AS updated_at FROM supplier""",
    "roles": """SELECT s_suppkey * 2 AS rid, s_suppkey AS eid, CAST(s_suppkey % 5 AS INTEGER) AS rdid,
        DATE '1995-01-01' AS start_date, CASE WHEN s_suppkey % 11 = 3 THEN DATE '2000-06-14' END AS end_date FROM supplier
        UNION ALL
        SELECT s_suppkey * 2 + 1, s_suppkey, CAST((s_suppkey + 1) % 5 AS INTEGER), DATE '1998-01-01', CAST(NULL AS DATE)
        FROM supplier WHERE s_suppkey % 4 = 0""",
    "services": """SELECT p_partkey AS sid, p_name AS name, concat_ws(' ', p_brand, p_type) AS description,
        CAST(30 * (1 + p_size % 8) AS INTEGER) AS duration_minutes, CAST(p_retailprice AS DECIMAL(10,2)) AS base_cost,
        DATE '1995-01-01' AS active_from,
        CASE WHEN p_partkey % 10 = 3 THEN DATE '2000-06-13' WHEN p_partkey % 10 = 4 THEN DATE '2000-06-14' END
          AS active_until,
        CAST(p_size % 5 AS INTEGER) AS rdid FROM part""",
    "_li": """SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
          l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
        s.duration_minutes,
        CAST(DATE '2000-02-15' + CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 128 AS INTEGER)
          AS TIMESTAMP) + (9 + l_partkey % 12) * INTERVAL '1' HOUR + (5 * l_linenumber) * INTERVAL '1' MINUTE
          AS scheduled_start
        FROM lineitem l LEFT JOIN services s ON s.sid = l.l_partkey""",
    "_li2": """SELECT *, CASE WHEN scheduled_start <= TIMESTAMP '2000-06-14 12:00:00' AND (l_orderkey + seq) % 50 <> 0
          AND scheduled_start + (2 * (l_linenumber % 3)) * INTERVAL '1' MINUTE <= TIMESTAMP '2000-06-14 12:00:00'
          THEN scheduled_start + (2 * (l_linenumber % 3)) * INTERVAL '1' MINUTE END AS actual_start FROM _li""",
    "transaction_items": """SELECT l_orderkey * 1000 + seq AS ttid, l_orderkey AS tid, l_partkey AS sid,
        l_suppkey AS therapist_eid, scheduled_start, scheduled_start + duration_minutes * INTERVAL '1' MINUTE
          AS scheduled_end, actual_start,
        CASE WHEN actual_start + (duration_minutes + 3 * (l_linenumber - 4)) * INTERVAL '1' MINUTE
                  <= TIMESTAMP '2000-06-14 12:00:00'
              AND NOT (l_suppkey % 3 = 0 AND (l_orderkey + seq) % 40 = 3)
             THEN actual_start + (duration_minutes + 3 * (l_linenumber - 4)) * INTERVAL '1' MINUTE END AS actual_end,
        CAST(l_extendedprice AS DECIMAL(10,2)) AS cost,
        CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_discount AS DECIMAL(3,2)) AS DECIMAL(10,2))
          AS item_discount,
        CASE WHEN l_discount > 0 THEN 'promo' ELSE 'none' END AS item_discount_type,
        CAST((l_orderkey * 7 + l_linenumber) % 20 AS INTEGER) AS rid FROM _li2""",
    "payments": """SELECT o_orderkey * 2 AS pid, o_orderkey AS tid,
        CASE o_orderkey % 6 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'NETS' WHEN 3 THEN 'PayNow'
          WHEN 4 THEN 'eWallet' ELSE 'Voucher' END AS payment_method,
        CAST(CAST(o_totalprice AS DECIMAL(10,2)) * CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 1.0 END AS DECIMAL(10,2))
          AS payment_amount,
        o_orderdate + (10 + o_orderkey % 10) * INTERVAL '1' HOUR AS payment_time FROM orders WHERE o_orderkey % 7 <> 0""",
    "refunds": """SELECT o_orderkey AS refid, o_orderkey AS tid,
        CASE o_orderkey % 6 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'NETS' WHEN 3 THEN 'PayNow'
          WHEN 4 THEN 'eWallet' ELSE 'Voucher' END AS refund_method,
        CAST(CAST(o_totalprice AS DECIMAL(10,2)) * 0.5 AS DECIMAL(10,2)) AS refund_amount,
        'service not delivered' AS refund_reason,
        o_orderdate + (34 + o_orderkey % 10) * INTERVAL '1' HOUR AS refund_time
        FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 10 = 0 AND o_orderkey % 7 <> 0""",
    "_isum": """SELECT tid, SUM(cost) AS items_cost, SUM(item_discount) AS items_discount
        FROM transaction_items GROUP BY tid""",
    "_psum": "SELECT tid, SUM(payment_amount) AS paid FROM payments GROUP BY tid",
    "_rsum": "SELECT tid, SUM(refund_amount) AS refunded FROM refunds GROUP BY tid",
    "transactions": """SELECT o_orderkey AS tid, o_custkey AS cid, o_orderkey % 10 AS cashier_eid,
        CAST(CASE WHEN o_orderkey % 8 = 0 AND i.tid IS NOT NULL THEN 5 ELSE 0 END AS DECIMAL(10,2)) AS billlevel_discount,
        CASE WHEN o_orderkey % 8 = 0 AND i.tid IS NOT NULL THEN 'promo' ELSE 'none' END AS billlevel_discount_type,
        CAST(COALESCE(i.items_cost, 0) AS DECIMAL(10,2)) AS total_cost,
        CAST(COALESCE(i.items_discount, 0)
             + CASE WHEN o_orderkey % 8 = 0 AND i.tid IS NOT NULL THEN 5 ELSE 0 END AS DECIMAL(10,2)) AS total_discount,
        CAST(COALESCE(p.paid, 0) - COALESCE(r.refunded, 0) AS DECIMAL(10,2)) AS total_paid,
        CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate + (9 + o_orderkey % 10) * INTERVAL '1' HOUR END AS entry_time,
        CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 97 <> 0
             THEN o_orderdate + (11 + o_orderkey % 10) * INTERVAL '1' HOUR END AS exit_time,
        CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 10 = 0 THEN 'refunded'
             WHEN o_orderkey % 10 = 1 THEN 'cancelled' WHEN o_orderstatus = 'P' THEN 'paid'
             WHEN o_orderkey % 2 = 0 THEN 'partial' ELSE 'pending' END AS status,
        o_orderdate + (9 + o_orderkey % 10) * INTERVAL '1' HOUR AS created_at,
        o_orderdate + (9 + o_orderkey % 10) * INTERVAL '1' HOUR AS updated_at
        FROM orders LEFT JOIN _isum i ON i.tid = o_orderkey LEFT JOIN _psum p ON p.tid = o_orderkey
        LEFT JOIN _rsum r ON r.tid = o_orderkey""",
}


def with_views(sql: str) -> str:
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items())
    body = sql.strip()
    if body[:4].upper() == "WITH":  # merge the query's own CTEs into the list
        return f"WITH RECURSIVE {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
