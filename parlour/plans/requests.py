"""Request generators: search terms, slot requests and change batches derived from the driver tables,
with the same rules in Spark and in DuckDB SQL. A batch of requests is by nature about some of the rows;
the modulus rules below say about which, and add the requests that an operator must refuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlour.functions.temporal import ts_lit
from parlour.sources.fixtures import read_raw


def employee_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_raw(spark, sf_dir)["supplier"]
    return s.where(s.s_suppkey % 7 == 0).select(
        s.s_suppkey.alias("term_id"), F.lpad((s.s_suppkey % 100).cast("string"), 2, "0").alias("q"))


EMPLOYEE_TERMS_SQL = """SELECT s_suppkey AS term_id, lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS q
FROM supplier WHERE s_suppkey % 7 = 0"""


def customer_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_raw(spark, sf_dir)["customer"]
    k = c.c_custkey
    return c.where(k % 40 == 1).select(k.alias("term_id"), F.when(k % 400 == 1, F.lit("7")).otherwise(
        F.concat(F.lit(" "), F.lpad((k * 3 % 100).cast("string"), 2, "0"), F.lit(" "))).alias("q"))


CUSTOMER_TERMS_SQL = """SELECT c_custkey AS term_id, CASE WHEN c_custkey % 400 = 1 THEN '7'
  ELSE ' ' || lpad(CAST(c_custkey * 3 % 100 AS VARCHAR), 2, '0') || ' ' END AS q FROM customer WHERE c_custkey % 40 = 1"""


def find_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_raw(spark, sf_dir)["customer"]
    k = c.c_custkey
    by = F.when(k % 4 == 0, "mobile").when(k % 4 == 1, "name").when(k % 4 == 2, "cid").otherwise("other")
    term = (F.when(k % 130 == 13, F.lit("")).when(k % 4 >= 2, (k * 41 % 2000).cast("string"))
            .otherwise(F.lpad((k * 37 % 1000).cast("string"), 3, "0")))
    return c.where(k % 13 == 0).select(k.alias("req_id"), by.alias("by"), term.alias("term"))


FIND_REQUESTS_SQL = """SELECT c_custkey AS req_id,
  CASE c_custkey % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'name' WHEN 2 THEN 'cid' ELSE 'other' END AS by,
  CASE WHEN c_custkey % 130 = 13 THEN '' WHEN c_custkey % 4 >= 2 THEN CAST(c_custkey * 41 % 2000 AS VARCHAR)
       ELSE lpad(CAST(c_custkey * 37 % 1000 AS VARCHAR), 3, '0') END AS term FROM customer WHERE c_custkey % 13 = 0"""


# ---- slot / booking / edit requests ------------------------------------------------------
def _counts(raw) -> DataFrame:
    return raw["part"].agg(F.count(F.lit(1)).alias("n_parts")).crossJoin(
        raw["supplier"].agg(F.count(F.lit(1)).alias("n_supp")))


def slot_requests(spark: SparkSession, sf_dir: str, as_of) -> DataFrame:
    """One booking request per order with tid % 50 = 2, on the as_of day."""
    from datetime import datetime

    raw = read_raw(spark, sf_dir)
    o = raw["orders"].where(F.col("o_orderkey") % 50 == 2).crossJoin(F.broadcast(_counts(raw)))
    tid = F.col("o_orderkey")
    day = ts_lit(datetime(as_of.year, as_of.month, as_of.day))
    return o.select(
        tid.alias("req_id"), tid.alias("tid"), (tid % F.col("n_parts")).alias("sid"),
        F.timestamp_add("HOUR", (9 + tid % 12).cast("int"), day).alias("slot_start"),
        (tid % F.col("n_supp")).alias("therapist_eid"), (tid % 20).cast("int").alias("rid"),
        F.when(tid % 7 == 0, F.lit(None).cast("double")).when(tid % 11 == 0, -5.0)
        .when(tid % 3 == 0, 10.0).when(tid % 3 == 1, 1000000.0).otherwise(0.0).alias("item_discount"),
        F.when(tid % 3 == 0, "promo").when(tid % 3 == 1, "management").otherwise("none").alias("item_discount_type"))


def slot_requests_sql(as_of) -> str:
    return f"""SELECT o_orderkey AS req_id, o_orderkey AS tid, o_orderkey % (SELECT COUNT(*) FROM part) AS sid,
  TIMESTAMP '{as_of:%Y-%m-%d} 00:00:00' + (9 + o_orderkey % 12) * INTERVAL '1' HOUR AS slot_start,
  o_orderkey % (SELECT COUNT(*) FROM supplier) AS therapist_eid, CAST(o_orderkey % 20 AS INTEGER) AS rid,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN -5.0
       WHEN o_orderkey % 3 = 0 THEN 10.0 WHEN o_orderkey % 3 = 1 THEN 1000000.0 ELSE 0.0 END AS item_discount,
  CASE o_orderkey % 3 WHEN 0 THEN 'promo' WHEN 1 THEN 'management' ELSE 'none' END AS item_discount_type
FROM orders WHERE o_orderkey % 50 = 2"""


def edit_requests(items: DataFrame) -> DataFrame:
    """One edit per item with ttid % 97 = 5: same service, staff and room, 30 minutes later."""
    i = items.where(F.col("ttid") % 97 == 5)
    return i.select(F.col("ttid").alias("req_id"), "ttid", "sid",
                    F.timestamp_add("MINUTE", F.lit(30), F.col("scheduled_start")).alias("slot_start"),
                    "therapist_eid", "rid", F.col("item_discount").cast("double").alias("item_discount"),
                    "item_discount_type")


EDIT_REQUESTS_SQL = """SELECT ttid AS req_id, ttid, sid, scheduled_start + INTERVAL '30' MINUTE AS slot_start,
  therapist_eid, rid, CAST(item_discount AS DOUBLE) AS item_discount, item_discount_type
FROM transaction_items WHERE ttid % 97 = 5"""


# ---- change batches ----------------------------------------------------------------------
def employment_changes(t) -> DataFrame:
    e = t["employees"]
    return e.where(F.col("eid") % 6 != 0).select(
        "eid", F.when(F.col("eid") % 6 == 1, F.lit("2000-06-30").cast("date"))
        .when(F.col("eid") % 6 == 5, F.lit("1997-06-30").cast("date")).alias("new_end"))


EMPLOYMENT_CHANGES_SQL = """SELECT eid, CASE WHEN eid % 6 = 1 THEN DATE '2000-06-30'
  WHEN eid % 6 = 5 THEN DATE '1997-06-30' END AS new_end FROM employees WHERE eid % 6 <> 0"""


def role_ids(t) -> DataFrame:
    r = t["roles"]
    return r.where(F.col("rid") % 7 == 3).select("rid").unionByName(
        r.where(F.col("rid") % 49 == 3).select((F.col("rid") + 1000000).alias("rid")))


ROLE_IDS_SQL = """SELECT rid FROM roles WHERE rid % 7 = 3
  UNION ALL SELECT rid + 1000000 FROM roles WHERE rid % 49 = 3"""


def role_requests(t, as_of) -> DataFrame:
    e = t["employees"].where(F.col("eid") % 5 == 2)
    return e.select(F.col("eid").alias("req_id"), "eid", ((F.col("eid") + 2) % 5).cast("int").alias("rdid"),
                    F.lit(as_of.date()).alias("start_date"),
                    F.when(F.col("eid") % 10 != 2, F.lit("2000-01-01").cast("date")).alias("end_date"))


def role_requests_sql(as_of) -> str:
    return f"""SELECT eid AS req_id, eid, CAST((eid + 2) % 5 AS INTEGER) AS rdid, DATE '{as_of:%Y-%m-%d}' AS start_date,
  CASE WHEN eid % 10 <> 2 THEN DATE '2000-01-01' END AS end_date FROM employees WHERE eid % 5 = 2"""


def delete_requests(t) -> DataFrame:
    ttids = t["transaction_items"].where(F.col("ttid") % 89 == 1).select("ttid")
    return ttids.unionByName(ttids.where(F.col("ttid") % 178 == 1))  # some asked for twice


DELETE_REQUESTS_SQL = """SELECT ttid FROM transaction_items WHERE ttid % 89 = 1
  UNION ALL SELECT ttid FROM transaction_items WHERE ttid % 178 = 1"""


def clock_events(t) -> DataFrame:
    i = t["transaction_items"].where(F.col("ttid") % 13 == 0)
    k, s, e = F.col("ttid"), F.col("scheduled_start"), F.col("scheduled_end")
    event = lambda n, kind, at: F.struct((k * 10 + n).alias("event_id"), F.lit(kind).alias("kind"), at.alias("event_time"))
    events = F.array_compact(F.array(
        event(1, "start", s), event(2, "end", e),
        F.when(k % 26 == 0, event(3, "end", F.timestamp_add("MINUTE", F.lit(5), e))),
        F.when(k % 39 == 0, event(4, "end", F.timestamp_add("MINUTE", F.lit(-10), s)))))
    return i.select("ttid", F.explode(events).alias("ev")).select("ev.event_id", "ttid", "ev.kind", "ev.event_time")


CLOCK_EVENTS_SQL = """SELECT ttid * 10 + 1 AS event_id, ttid, 'start' AS kind, scheduled_start AS event_time
  FROM transaction_items WHERE ttid % 13 = 0
UNION ALL SELECT ttid * 10 + 2, ttid, 'end', scheduled_end FROM transaction_items WHERE ttid % 13 = 0
UNION ALL SELECT ttid * 10 + 3, ttid, 'end', scheduled_end + INTERVAL '5' MINUTE FROM transaction_items
  WHERE ttid % 13 = 0 AND ttid % 26 = 0
UNION ALL SELECT ttid * 10 + 4, ttid, 'end', scheduled_start - INTERVAL '10' MINUTE FROM transaction_items
  WHERE ttid % 13 = 0 AND ttid % 39 = 0"""


def payment_requests(spark: SparkSession, sf_dir: str, as_of) -> DataFrame:
    from parlour.sources.fixtures import _method

    o = read_raw(spark, sf_dir)["orders"].where(F.col("o_orderkey") % 11 == 4)
    tid = F.col("o_orderkey")
    quarter = F.floor(F.col("o_totalprice") / 4).cast("long").cast("string")
    half = F.floor(F.col("o_totalprice") / 2).cast("long").cast("string")
    return o.select(
        tid.alias("req_id"), F.when(tid % 35 == 2, tid + 10000000).otherwise(tid).alias("tid"),
        F.array(_method(tid), F.when(tid % 35 == 1, F.lit("Bitcoin")).otherwise(_method(tid + 1))).alias("methods"),
        F.when(tid % 35 == 0, F.array(quarter, F.lit("abc"))).when(tid % 35 == 1, F.array(quarter, F.lit("5")))
        .when(tid % 3 == 0, F.array(quarter, F.lit("0"), F.lit("12.50"))).otherwise(F.array(half)).alias("amounts"),
        ts_lit(as_of).alias("event_time"))


PAY_METHOD_SQL = """CASE {k} % 6 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'NETS' WHEN 3 THEN 'PayNow'
  WHEN 4 THEN 'eWallet' ELSE 'Voucher' END"""


def payment_requests_sql(as_of) -> str:
    m0, m1 = PAY_METHOD_SQL.format(k="o_orderkey"), PAY_METHOD_SQL.format(k="(o_orderkey + 1)")
    quarter = "CAST(CAST(floor(o_totalprice / 4) AS BIGINT) AS VARCHAR)"
    return f"""SELECT o_orderkey AS req_id, CASE WHEN o_orderkey % 35 = 2 THEN o_orderkey + 10000000 ELSE o_orderkey END AS tid,
  [{m0}, CASE WHEN o_orderkey % 35 = 1 THEN 'Bitcoin' ELSE {m1} END] AS methods,
  CASE WHEN o_orderkey % 35 = 0 THEN [{quarter}, 'abc'] WHEN o_orderkey % 35 = 1 THEN [{quarter}, '5']
       WHEN o_orderkey % 3 = 0
       THEN [CAST(CAST(floor(o_totalprice / 4) AS BIGINT) AS VARCHAR), '0', '12.50']
       ELSE [CAST(CAST(floor(o_totalprice / 2) AS BIGINT) AS VARCHAR)] END AS amounts,
  TIMESTAMP '{as_of:%Y-%m-%d %H:%M:%S}' AS event_time
FROM orders WHERE o_orderkey % 11 = 4"""


def exit_requests(t, as_of) -> DataFrame:
    x = t["transactions"].where(F.col("tid") % 13 == 6).select("tid", ts_lit(as_of).alias("event_time"))
    late = F.timestamp_add("MINUTE", F.lit(5), F.col("event_time")).alias("event_time")
    return x.unionByName(x.where(F.col("tid") % 26 == 6).select("tid", late))  # some recorded twice


def exit_requests_sql(as_of) -> str:
    return f"""SELECT tid, TIMESTAMP '{as_of:%Y-%m-%d %H:%M:%S}' AS event_time FROM transactions WHERE tid % 13 = 6
  UNION ALL SELECT tid, TIMESTAMP '{as_of:%Y-%m-%d %H:%M:%S}' + INTERVAL '5' MINUTE FROM transactions WHERE tid % 26 = 6"""
