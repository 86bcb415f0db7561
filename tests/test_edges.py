"""Hand-made edge tables: boundaries, ties, NULLs and empty groups."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from parlour.operators import changes as ch
from parlour.operators import compliance as cp
from parlour.operators import customer as cu
from parlour.operators import slots as sl
from parlour.operators import staff as st
from parlour.operators import therapist as th
from parlour.sources.fixtures import ROLE_TYPES
from parlour.sources.schemas import SCHEMAS
from parlour.sources.tables import conform

AS_OF = datetime(2000, 6, 14, 12, 0)
D = date(2000, 6, 14)


def _df(spark, name, rows):
    from decimal import Decimal

    from pyspark.sql.types import DecimalType

    dec = [isinstance(f.dataType, DecimalType) for f in SCHEMAS[name].fields]
    rows = [tuple(Decimal(v) if d and v is not None else v for v, d in zip(r, dec)) for r in rows]
    return conform(spark.createDataFrame(rows, SCHEMAS[name]), name)


@pytest.fixture()
def base(spark):
    ts = datetime(1995, 1, 1, 9)
    emp = [(e, f"E{e}", f"Name {e}", f"W{e}", "Male", "123", "01", date(1995, 1, 1), end, ts, ts)
           for e, end in [(1, None), (2, D), (3, date(2000, 6, 13)), (4, None)]]
    roles = [(10, 1, 0, date(1995, 1, 1), None), (11, 2, 0, date(1995, 1, 1), D),  # role ending on as_of: inactive
             (12, 4, 0, date(1995, 1, 1), None), (13, 4, 1, date(1995, 1, 1), None)]  # double role
    return {
        "employees": _df(spark, "employees", emp),
        "roles": _df(spark, "roles", roles),
        "role_definition": _df(spark, "role_definition", list(enumerate(ROLE_TYPES))),
    }


def test_half_open_roles_and_employment_variants(spark, base):
    ar = {r.rid for r in st.active_roles(base, AS_OF).collect()}
    assert ar == {10, 12, 13}
    inc = {r.eid for r in st.employed(base, AS_OF, inclusive=True).collect()}
    exc = {r.eid for r in st.employed(base, AS_OF, inclusive=False).collect()}
    assert inc == {1, 2, 4} and exc == {1, 4}


def test_profile_empty_roles_is_null(spark, base):
    p = {r.eid: r.roles for r in st.employee_profile(base, AS_OF).collect()}
    assert p[2] is None and p[4] == "Beautician, Senior Therapist"


def _items(spark, rows):
    full = []
    for ttid, tid, eid, s, e, a_s, a_e, cost, rid in rows:
        full.append((ttid, tid, 1, eid, s, e, a_s, a_e, cost, 0, "none", rid))
    return _df(spark, "transaction_items", full)


def test_leaderboard_double_role_and_ties(spark, base):
    m = datetime(2000, 6, 2, 10)
    items = _items(spark, [(1, 1, 1, m, m, m, m, 100, 0), (2, 1, 4, m, m, m, m, 50, 0)])
    t = {**base, "transaction_items": items}
    rows = {r.eid: r for r in th.leaderboard(t, AS_OF).collect()}
    # eid 4 holds two therapist-like roles: revenue counted twice (100 = 2 x 50), tied with eid 1
    assert float(rows[4].revenue) == 100.0 and float(rows[1].revenue) == 100.0
    assert rows[1].rank == rows[4].rank == 1
    assert float(rows[1].person_below_revenue) == 100.0  # tie broken by eid
    assert 2 not in rows  # role ended on as_of
    dd = {r.eid: r for r in th.therapist_revenue(t, AS_OF, dedupe_roles=True).collect()}
    assert float(dd[4].revenue) == 50.0


def test_touching_slots_do_not_conflict(spark, base):
    s0, s1 = datetime(2000, 6, 14, 10), datetime(2000, 6, 14, 11)
    items = _items(spark, [(1, 1, 1, s0, s1, None, None, 10, 0)])
    ts = datetime(2000, 6, 1)
    tx = _df(spark, "transactions", [(1, 7, 1, 0, "none", 10, 0, 0, ts, None, "pending", ts, ts),
                                     (2, 7, 1, 0, "none", 0, 0, 0, ts, None, "pending", ts, ts)])
    svc = _df(spark, "services", [(1, "Massage", "d", 60, 10, date(1995, 1, 1), None, 0)])
    t = {**base, "transaction_items": items, "transactions": tx, "services": svc}
    req = spark.createDataFrame([(1, 2, 1, s1), (2, 2, 1, datetime(2000, 6, 14, 10, 59))],
                                "req_id long, tid long, sid long, slot_start timestamp_ntz")
    got = {r.req_id for r in sl.customer_conflicts(t, req).collect()}
    assert got == {2}


def test_payment_intake_zip_truncates_and_drops_non_positive(spark):
    req = spark.createDataFrame([(1, 5, ["Cash", "NETS"], ["10", "0", "7"], AS_OF), (2, 6, ["Cash"], ["-1"], AS_OF)],
                                "req_id long, tid long, methods array<string>, amounts array<string>, "
                                "event_time timestamp_ntz")
    ts = datetime(2000, 6, 1)
    tx = _df(spark, "transactions", [(k, 7, 1, 0, "none", 0, 0, 0, ts, None, "pending", ts, ts) for k in (5, 6)])
    rows = ch.payment_intake({"transactions": tx}, req).collect()
    assert [(r.tid, r.payment_method, float(r.payment_amount)) for r in rows] == [(5, "Cash", 10.0)]


def test_three_month_log_midnight_cut(spark):
    lo, hi, incl = cp.period_window("3months", date(2000, 3, 1))
    assert (hi, incl) == (datetime(2000, 5, 31), True)
    lo, hi, incl = cp.period_window("3months", date(2000, 3, 1), inclusive_end=True)
    assert (hi, incl) == (datetime(2000, 6, 1), False)
    assert cp.period_window("fortnight", date(2000, 3, 1))[1] == datetime(2000, 3, 2)


def test_invoice_without_items_keeps_empty_list(spark, base):
    ts = datetime(2000, 6, 1)
    tx = _df(spark, "transactions", [(1, 7, 1, 0, "none", 0, 0, 0, ts, None, "pending", ts, ts)])
    t = {**base, "transactions": tx, "transaction_items": _items(spark, []),
         "services": _df(spark, "services", [])}
    r = cu.invoice_items(t).collect()
    assert len(r) == 1 and r[0]["items"] == []


def test_service_clock_orders_events(spark):
    s = datetime(2000, 6, 14, 10)
    items = _items(spark, [(1, 1, 1, s, s, None, None, 10, 0), (2, 1, 1, s, s, s, s, 10, 0)])
    ev = spark.createDataFrame([
        (1, 1, "end", datetime(2000, 6, 14, 9)), (2, 1, "start", datetime(2000, 6, 14, 10)),
        (3, 1, "start", datetime(2000, 6, 14, 10, 1)), (4, 1, "end", datetime(2000, 6, 14, 11)),
        (5, 1, "end", datetime(2000, 6, 14, 11, 5)), (6, 2, "end", datetime(2000, 6, 14, 11)),
        (7, 99, "start", datetime(2000, 6, 14, 11))],
        "event_id long, ttid long, kind string, event_time timestamp_ntz")
    got = {r.event_id: r.reason for r in ch.service_clock({"transaction_items": items}, ev).collect()}
    assert got == {1: ch.MSG_NOT_STARTED, 2: None, 3: ch.MSG_ALREADY_STARTED, 4: None, 5: ch.MSG_ALREADY_ENDED,
                   6: ch.MSG_ALREADY_ENDED, 7: "Service not found"}


def test_transaction_detail_matches_brute_force(spark):
    from parlour.plans.tables import tables

    t = tables(spark, "/root/testdata/sf0.001")
    det = {r.tid: r for r in cu.transaction_detail(t).collect()}
    items = t["transaction_items"].groupBy("tid").agg(F.count(F.lit(1)).alias("n")).collect()
    pays = t["payments"].groupBy("tid").agg(F.max("payment_time").alias("m")).collect()
    for r in items:
        assert len(det[r.tid]["items"]) == r.n
    for r in pays:
        assert det[r.tid]["payments"][0]["payment_time"] == r.m


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_distributed_ranking_equals_single_task_window(spark, parts):
    import random

    from pyspark.sql import Window

    from parlour.functions.ranking import global_rank_lag_lead

    random.seed(parts)
    rows = [(i, float(random.choice([0, 0, 0, 0, 5, 7, 12, 12, 30]))) for i in range(400)]
    df = spark.createDataFrame(rows, "eid long, revenue double")
    got = {r.eid: (r.rank, r.above, r.below)
           for r in global_rank_lag_lead(df, "revenue", "eid", n_parts=parts).collect()}
    w1, w2 = Window.orderBy(F.desc("revenue")), Window.orderBy(F.desc("revenue"), "eid")
    exp = {r.eid: (r.rk, r.a, r.b) for r in df.select(
        "eid", F.rank().over(w1).alias("rk"), F.lag("revenue").over(w2).alias("a"),
        F.lead("revenue").over(w2).alias("b")).collect()}
    assert got == exp


def test_invoice_headers_read_the_items_once(spark):
    from parlour.plans.tables import tables

    t = tables(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scans = lambda df: len([s for s in plan(df).split("FileScan ") if "lineitem.parquet" in s])
    assert scans(t["transactions"]) == 1 and scans(cu.transaction_detail(t)) == 2  # the headers' totals, the lists
    assert scans(t["transactions"].select("tid", "cid", "status")) == 0


def test_times_as_json_text_with_and_without_a_fraction(spark):
    from parlour.sources.sinks import json_ready

    at = [datetime(2000, 6, 14, 10), datetime(2000, 6, 14, 10, 0, 0, 500), datetime(1961, 1, 2, 3, 4, 5), datetime(1961, 1, 2, 3, 4, 5, 999999), None]
    df = spark.createDataFrame([(i, [x], x) for i, x in enumerate(at)], "i int, l array<timestamp_ntz>, x timestamp_ntz")
    got = json_ready(df).orderBy("i").collect()
    assert [r.x for r in got] == [x and x.isoformat() for x in at] == [r.l[0] for r in got]
    text = json_ready(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "date_trunc" in text.lower() or "trunctimestamp" in text.lower()  # whole seconds take the short pattern
