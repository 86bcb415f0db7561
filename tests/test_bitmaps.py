"""Sets as bitmaps a page against plain Python, and what is shuffled for free sets and lists."""

import random
from datetime import datetime

from final_plan import _walk
from pyspark.sql import functions as F
from test_order_and_slots import _seq, at, spans
from test_probes import _df, item, t  # noqa: F401

from parlour.functions.bitmaps import PAGE, is_set, listed_sets, member_sets, overlapping_sets
from parlour.operators import live_at
from parlour.operators import slots as sl


def keys_of(page, words):
    return {page * PAGE + 64 * i + j for i, w in enumerate(words) for j in range(64) if w >> j & 1}


def test_sets_equal_all_pairs(spark, request):
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a group's rows come in many batches
    rng = random.Random(31)
    items = [(rng.choice((None, -1, 0, 1, 63, 64, 4095, 4096, 5000, -4097)), s, e) for _, s, e in spans(rng, 600)]
    slots = [(s, e, page) for _, s, e in spans(rng, 120) for page in (-2, -1, 0, 1, 9)]
    a = spark.createDataFrame(slots, "slot_start timestamp_ntz, slot_end timestamp_ntz, page long")
    b = spark.createDataFrame(items, "key long, start timestamp_ntz, end timestamp_ntz").repartition(3)
    rows = overlapping_sets(a, b).collect()
    got = {(r.slot_start, r.slot_end, r.page): keys_of(r.page, r.busy) for r in rows}
    assert len(got) == len(rows) and all(len(r.busy) == PAGE // 64 for r in rows)
    expected = {}
    for s, e, page in slots:
        met = {k for k, x, y in items if k is not None and k // PAGE == page and e and y and x < e and y > s}
        if met:
            expected[(s, e, page)] = met
    assert got == expected


def test_members_that_are_not_busy_are_listed(spark):
    rows = [(1, k) for k in (-5000, -1, 0, 1, 2, 4095, 4096, 4096)] + [(2, 7), (None, 8), (2, None)]
    members = member_sets(spark.createDataFrame(rows, "cls int, key int"))
    busy = spark.createDataFrame([(0, [2] + [0] * 62 + [1 << 62])], "page long, busy array<long>")
    got = {(r.cls, r.page): (r.n_free, r.free) for r in listed_sets(members.join(busy, "page", "left"), ["cls"]).collect()}
    assert got == {(1, -2): (1, "-5000"), (1, -1): (1, "-1"), (1, 0): (3, "0,2,4095"), (1, 1): (1, "4096"), (2, 0): (1, "7"), (None, 0): (1, "8")}
    row = spark.createDataFrame([([2] + [0] * 62 + [-1 << 63], None)], "a array<long>, b array<long>")
    assert row.select(*[is_set(c, F.lit(k).cast("long")) for c in "ab" for k in (1, 2, 4095, -1, -2)]).first()[:] == (True, False, True, True, False) + (False,) * 5


def test_a_chunk_of_requests_takes_the_place_of_each(spark):
    links = spark.createDataFrame([(i, at(0), at(60), 1) for i in [*range(1000), 3, None, None]] + [(7, None, None, 1), (8, at(0), at(60), None)],
                                  "req_id long, slot_start timestamp_ntz, slot_end timestamp_ntz, cls int")
    rows = sl._asked_by(links).collect()
    asked = [q for r in rows if r.slot_start for q in r.reqs]
    assert len(rows) <= 1 + 1002 // sl.CHUNK + 1 and len(asked) == 1001 and set(asked) == {*range(1000), None}
    assert [r.reqs for r in rows if not r.slot_start] == [[7]]


def shuffled(df):
    df.collect()
    return [{a.name() for a in _seq(n.output())} for n in _walk(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "ShuffleExchangeExec"]


def test_no_row_a_request_a_word_or_a_member_of_staff_is_shuffled(spark, t, request):  # noqa: F811
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    now = datetime(1995, 6, 1)
    t["transaction_items"] = _df(spark, "transaction_items", [item(i, 1 + i % 3, at(30 * i)) for i in range(1, 9)])
    e = spark.createDataFrame([(i, i) for i in range(1, 9)], "req_id long, ttid long")
    r = spark.createDataFrame([(i, 1, 1, at(60)) for i in range(1, 9)], "req_id long, tid long, sid long, slot_start timestamp_ntz")
    for df in (sl.edit_candidate_therapists(t, e, now), sl.candidate_therapists(t, r, now), sl.edit_therapist_slot_sets(t, e, now)):
        found = shuffled(df)
        assert sum("busy" in columns for columns in found) == 1  # no bitmap is sent twice after it was merged
        for columns in found:
            assert not {"req_id", "busy"} <= columns and not {"slot_start", "word"} <= columns, columns
    for columns in shuffled(live_at.staff_available_at(t, spark.createDataFrame([(at(30 * i),) for i in range(9)], "at timestamp_ntz"))):
        assert not {"day", "eid"} <= columns and not {"slot_start", "word"} <= columns, columns
