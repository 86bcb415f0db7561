"""Requests served in order, islands of intervals, overlap by levels, and free sets of slots: against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlour.functions.intervals import LEVELS, level_buckets, time_overlap_pairs
from parlour.functions.islands import islands
from parlour.functions.sequential import serve_in_order
from parlour.operators import changes as ch
from parlour.operators import slots as sl
from test_probes import T0, _df, item, t  # noqa: F401

REQ = ("req_id long, grp long, owner long, party long, s timestamp_ntz, e timestamp_ntz, name string, blocked boolean, holds boolean, "
       "old_s timestamp_ntz, old_e timestamp_ntz, old_name string")


def at(n):
    return T0 + timedelta(minutes=n)


def one_by_one(rows):
    out, places = {}, {}
    for r in sorted(rows):
        _, grp, owner, party, *_, old_s, old_e, old_name = r
        if old_s is not None:
            places[(grp, owner)] = (old_s, old_e, party, old_name)
    for req, grp, owner, party, s, e, name, blocked, holds, *_ in sorted(rows):
        met = [(p[0], o, p[1], p[3]) for (g, o), p in places.items() if g == grp and o != owner and p[2] != party and p[0] < e and p[1] > s]
        ok = not met and not blocked
        if ok:
            places.pop((grp, owner), None)
            if holds:
                places[(grp, owner)] = (s, e, party, name)
        out[req] = (ok, min(met) if met else None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_served_in_order_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    old = {o: (at(m := rng.randrange(3000)), at(m + rng.choice([30, 60])), f"old {o}") if rng.random() < 0.6 else (None, None, None) for o in range(150)}
    rows = []
    for req in rng.sample(range(10000), 300):
        owner, m = rng.randrange(150), rng.randrange(3000)
        rows.append((req, owner % 3, owner, owner % 40, at(m), at(m + rng.choice([0, 20, 60, 90])), f"r{req}", rng.random() < 0.1, rng.random() < 0.9, *old[owner]))
    got = {r.req_id: (r.accepted, tuple(r.clash) if r.clash else None) for r in serve_in_order(spark.createDataFrame(rows, REQ)).collect()}
    assert got == one_by_one(rows)


def test_a_chain_of_a_thousand_rivals_takes_no_more_jobs_than_two(spark):
    def jobs(n):
        rows = [(i, 1, i, i, at(30 * i), at(30 * i + 45), "s", False, True, None, None, None) for i in range(n)]
        df = spark.createDataFrame(rows, REQ).repartition(4)
        spark.sparkContext.setJobGroup(f"chain {n}", "")
        got = {r.req_id: r.accepted for r in serve_in_order(df).collect()}
        assert got == {i: i % 2 == 0 for i in range(n)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain {n}"))

    try:
        assert jobs(1000) <= jobs(2) + 3  # adaptive execution may start a stage or two as jobs of their own
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_islands_of_large_and_small_groups(spark):
    rng = random.Random(4)
    rows = [(g, at(m := rng.randrange(20000)), at(m + rng.choice([0, 10, 400]))) for g, n in ((1, 700), (2, 5), (3, 1)) for _ in range(n)]
    got = islands(spark.createDataFrame(rows, "g long, a timestamp_ntz, b timestamp_ntz").repartition(6), "g", "a", "b").collect()
    assert sorted((r.g, r.a, r.b) for r in got) == sorted(rows)
    expected, reach, begin, last = {}, None, None, None
    for g, a, b in sorted(rows):
        if g != last or a >= reach:
            begin, reach, last = a, b, g
        reach = max(reach, b)
        expected.setdefault((g, a, b), begin)
    assert all(r.island == expected[(r.g, r.a, r.b)] for r in got)


def spans(rng, n):
    lengths = [0, 1, 45, 60, 61, 1440, 1500, 60 * 24 * 40, 60 * 24 * 3700]
    return [(i, at(m := rng.randrange(-200000, 200000)), at(m + rng.choice(lengths))) for i in range(n)] + [(n, at(500), at(100)), (n + 1, at(0), None)]


def test_overlap_by_levels_equals_all_pairs(spark):
    rng = random.Random(8)
    left, right = spans(rng, 250), spans(rng, 250)
    a = spark.createDataFrame(left, "i long, a timestamp_ntz, b timestamp_ntz")
    b = spark.createDataFrame(right, "j long, c timestamp_ntz, d timestamp_ntz")
    got = sorted((r.i, r.j) for r in time_overlap_pairs(a, b, ("a", "b"), ("c", "d")).collect())
    assert got == sorted((i, j) for i, x, y in left for j, v, w in right if y and w and v < y and w > x)


def test_ten_years_are_few_buckets(spark):
    df = spark.createDataFrame([(at(0), at(60 * 24 * 3653)), (at(0), at(60))], "a timestamp_ntz, b timestamp_ntz")
    long, short = [r.n for r in df.select(F.size(level_buckets(F.col("a"), F.col("b"))).alias("n")).collect()]
    assert long <= 4 and short <= 2 * len(LEVELS)


def edits(spark, rows):
    return spark.createDataFrame([(r, ttid, sid, start, 1, 1, 0.0, "none") for r, ttid, sid, start in rows],
                                 "req_id long, ttid long, sid long, slot_start timestamp_ntz, therapist_eid long, rid int, item_discount double, item_discount_type string")


def test_edits_of_one_batch_are_served_in_order(spark, t):  # noqa: F811
    # all invoices are one customer's, a service takes an hour
    t["transaction_items"] = _df(spark, "transaction_items", [item(1, 1, at(0)), item(2, 2, at(120)), item(3, 2, at(600))])
    cid = {r.tid: r.cid for r in t["transactions"].collect()}
    assert cid[1] == cid[2]
    text = "Customer already has a booking during this time: Massage (%s - %s)"
    freed = {r.req_id: (r.accepted, r.reason) for r in ch.edit_items(t, edits(spark, [(1, 1, 1, at(300)), (2, 2, 1, at(10))])).collect()}
    assert freed == {1: (True, None), 2: (True, None)}  # the first frees the place that the second needs
    held = {r.req_id: (r.accepted, r.reason) for r in ch.edit_items(t, edits(spark, [(1, 2, 1, at(10)), (2, 1, 1, at(300))])).collect()}
    assert held == {1: (False, text % ("09:00", "10:00")), 2: (True, None)}  # too early
    both = {r.req_id: (r.accepted, r.reason) for r in ch.edit_items(t, edits(spark, [(5, 1, 1, at(300)), (6, 2, 1, at(330)), (7, 3, 1, at(0)), (8, 1, 1, at(30)), (9, 1, 9, at(0))])).collect()}
    assert both == {5: (True, None), 6: (False, text % ("14:00", "15:00")), 7: (True, None), 8: (False, text % ("09:00", "10:00")), 9: (False, ch.MSG_SERVICE_NOT_FOUND)}


def test_a_slot_is_free_to_an_edit_whose_item_alone_takes_it(spark, t):  # noqa: F811
    now = datetime(1995, 6, 1)
    rows = [item(1, 1, at(0)), item(2, 2, at(30)), item(3, 3, at(600)), item(4, 1, at(900), None, at(900), at(930))]
    t["transaction_items"] = _df(spark, "transaction_items", rows)
    e = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4)], "req_id long, ttid long")
    own = {r.req_id: r.own for r in sl.edit_links(t, e, "therapist_eid").collect()}
    eid = rows[0][3]
    assert own == {1: None, 2: None, 3: eid, 4: None}  # 1 and 2 overlap, 4 has ended and takes nothing
    free = {r.slot_start: r.free for r in sl.edit_therapist_slot_sets(t, e, now).collect()}
    listed = {(r.req_id, r.eid) for r in sl.edit_candidate_therapists(t, e, now).collect()}
    assert {(i, eid) in listed for i in (1, 2)} == {False} and {(i, eid) in listed for i in (3, 4)} == {True}
    assert str(eid) not in free[at(600)].split(",") and str(eid) in free[at(900)].split(",")


def test_a_thousand_instants_equal_single_answers(spark, t):  # noqa: F811
    from parlour.operators import live, live_at

    rng = random.Random(12)
    rows = [item(i, rng.choice((1, 2, 3)), at(m := rng.randrange(0, 2000)), at(m + rng.choice((0, 30, 600))), None, at(m) if i % 9 == 0 else None, eid=rng.choice((1, 2))) for i in range(60)]
    t["transaction_items"] = _df(spark, "transaction_items", rows)
    asked = [at(rng.randrange(-10, 2700)) for _ in range(1000)] + [None]
    df = spark.createDataFrame([(a,) for a in asked], "at timestamp_ntz")
    going = {a: {r[0] for r in rows if r[7] is None and r[4] <= a <= r[5]} for a in asked if a}
    got = {}
    for r in live_at.busy_at(t, df).collect():
        got.setdefault(r.at, set()).add(r.ttid)
    assert got == {a: v for a, v in going.items() if v}
    assert {r.at: r.in_progress for r in live_at.busy_counts_at(t, df).collect()} == {a: len(v) for a, v in going.items()}
    free = {r.at: r.free for r in live_at.rooms_available_at(t, df).collect()}
    staff = {r.at: r.free for r in live_at.staff_available_at(t, df).collect()}
    for a in rng.sample(sorted(going), 3):
        assert free[a] == ",".join(str(r.rid) for r in live.rooms_available_now(t, a).collect())
        assert staff[a] == ",".join(str(r.eid) for r in live.staff_available_now(t, a).collect())
        assert got.get(a, set()) == {r.ttid for r in live.busy_now(t, a).collect()}


def test_lists_of_free_resources_are_not_shuffled(spark, t, request):  # noqa: F811
    from final_plan import _walk

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    now = datetime(1995, 6, 1)
    t["transaction_items"] = _df(spark, "transaction_items", [item(i, 1 + i % 3, at(30 * i)) for i in range(1, 9)])
    e = spark.createDataFrame([(i, i) for i in range(1, 9)], "req_id long, ttid long")
    for df in (sl.edit_therapist_slot_sets(t, e, now), sl.edit_candidate_therapists(t, e, now), sl.edit_candidate_rooms(t, e)):
        df.collect()
        columns = [[a.name() for a in _seq(node.output())] for node in _walk(df._jdf.queryExecution().executedPlan()) if node.getClass().getSimpleName() == "ShuffleExchangeExec"]
        assert any("busy" in c for c in columns)
        assert all("slot_start" not in c and "req_id" not in c and "free" not in c for c in columns if "entries" in c), columns


def _seq(s):
    return [s.apply(i) for i in range(s.size())]


def test_an_open_role_is_cut_to_the_days_asked_for(spark, t, monkeypatch):  # noqa: F811
    from parlour.operators import live_at

    given = []
    plain = live_at.time_overlap_pairs
    monkeypatch.setattr(live_at, "time_overlap_pairs", lambda left, right, a, b: given.append(right) or plain(left, right, a, b))
    days = spark.createDataFrame([(at(0).date(),), (at(60 * 24 * 40).date(),)], "day date")
    got = {(r.day, r.eid) for r in live_at.staff_on_days(t, days).collect()}
    assert got and all(r.r1.year < 2100 for r in given[0].collect())
    held = given[0].select(F.size(level_buckets(F.col("r0"), F.col("r1"))).alias("n")).collect()
    assert all(r.n <= 8 for r in held)
