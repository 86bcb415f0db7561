"""Totals kept current from changes: streamed (D9) and by batches (D2, D4-D6), against recomputation."""

import random
import re
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_probes import T0, _df, item, t  # noqa: F401

from parlour.streaming.net_paid import CHANGE, current_totals, run_changes


def test_streamed_changes_equal_the_rows_they_leave(spark, tmp_path):
    rng = random.Random(6)
    rows, seq, expected = {}, 0, {}
    for part in range(3):
        out = []
        for _ in range(60):
            seq += 1
            k = (rng.choice(["payment", "refund"]), rng.randrange(12))
            if k in rows and rng.random() < 0.3:
                rows.pop(k)
                out.append((*k, seq, "delete", None, None))
            else:
                op, rows[k] = "update" if k in rows else "insert", (rng.randrange(5), Decimal(rng.randrange(1, 5000)) / 100)
                out.append((*k, seq, op, *rows[k]))
        out.append((*rng.choice(list(rows)), 0, "update", 3, Decimal("777.77")))  # older than what is known: ignored
        rng.shuffle(out)
        spark.createDataFrame(out, CHANGE).repartition(2).write.mode("append").parquet(f"{tmp_path}/changes")
        sink = run_changes(spark, f"{tmp_path}/changes", str(tmp_path))
        expected = {}
        for (kind, _), (tid, amount) in rows.items():
            expected[tid] = expected.get(tid, 0) + (amount if kind == "payment" else -amount)
        got = {r.tid: r.total_paid for r in current_totals(spark, sink).collect()}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in expected.items() if v}
    again = current_totals(spark, run_changes(spark, f"{tmp_path}/changes", str(tmp_path)))  # nothing new: nothing changes
    assert {r.tid: r.total_paid for r in again.collect()} == got


def test_batches_read_the_touched_ranges_and_write_the_touched_invoices(spark, t, tmp_path, monkeypatch):  # noqa: F811
    from parlour.operators import derive as dv
    from parlour.operators import maintained as mt

    monkeypatch.setattr(mt, "RANGE", 10)
    ts, rng = datetime(1995, 1, 1, 9), random.Random(2)
    tx = [(i, 1, 1, 0, "none", 0, 0, 0, ts, None, "pending", ts, ts) for i in range(50)]
    t["transactions"] = _df(spark, "transactions", tx)
    path = str(tmp_path / "invoices")
    mt.start(t["transactions"], path)
    items, pays, status, left = {}, {}, dict.fromkeys(range(50), "pending"), {}
    for k in range(1, 4):
        low = 10 * k
        changes, money, events, touched = [], [], set(), set()
        for _ in range(25):
            key = rng.randrange(low, low + 10)
            old = items.get(key)
            new = None if old and rng.random() < 0.3 else (rng.randrange(10 if rng.random() < 0.2 else low, low + 10), Decimal(rng.randrange(1, 90)), Decimal(0))
            changes.append((old, new))
            items[key] = new
            touched |= {r[0] for r in (old, new) if r}
        for _ in range(10):
            key = rng.randrange(low, low + 10)
            old, new = pays.get(key), (key, Decimal(rng.randrange(0, 200)))
            money.append((old, new))
            pays[key] = new
            events.add(key)
        out = [(low, T0), (low + 1, T0), (9999, T0)]
        left.update({i: T0 for i, _ in out})
        events |= {low, low + 1}
        row = "struct<tid:bigint,cost:decimal(10,2),item_discount:decimal(10,2)>"
        amounts = mt.item_amounts(spark.createDataFrame(changes, f"old {row}, new {row}")).unionByName(
            mt.payment_amounts(spark.createDataFrame(money, "old struct<tid:bigint,payment_amount:decimal(10,2)>, new struct<tid:bigint,payment_amount:decimal(10,2)>")))
        exits = spark.createDataFrame(out, "tid long, exit_time timestamp_ntz")
        plan = mt.touched_invoices(spark, path, k, amounts, exits)._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "_range" in filters and "_version" in filters
        for _ in range(2):  # a batch that is run again changes nothing
            mt.apply_batch(spark, path, k, amounts, exits)
        written = {r.tid for r in spark.read.parquet(f"{path}/_version={k}").collect()}
        assert written == touched | events
        for i in written:
            cost = sum(r[1] for r in items.values() if r and r[0] == i)
            paid = sum(r[1] for r in pays.values() if r[0] == i)
            if status[i] in dv.OPEN_STATUSES:
                status[i] = "pending" if paid <= 0 else "partial" if paid < cost else "paid"
            if i in events and cost - paid <= 0 and i in left:
                status[i] = "completed"
    got = {r.tid: (r.total_cost, r.total_paid, r.exit_time, r.status) for r in mt.current(spark, path).collect()}
    assert got == {i: (sum((r[1] for r in items.values() if r and r[0] == i), Decimal(0)), sum((r[1] for r in pays.values() if r[0] == i), Decimal(0)),
                       left.get(i), status[i]) for i in range(50)}
    assert len(set(status.values())) >= 3
    mt.compact(spark, path, str(tmp_path / "one"), 3)
    assert sorted(mt.current(spark, str(tmp_path / "one")).collect()) == sorted(mt.current(spark, path).collect())


def test_deletions_cascade_or_are_refused(spark, t):  # noqa: F811
    from parlour.operators import changes as ch

    t["transaction_items"] = _df(spark, "transaction_items", [item(1, 1, T0), item(2, 1, T0), item(3, 2, T0, eid=2)])
    t["payments"] = _df(spark, "payments", [(1, 1, "Cash", 5, T0), (2, 3, "Cash", 5, T0)])
    keys = lambda *k: spark.createDataFrame([(i,) for i in k], "key long")
    rows = lambda df: sorted((r.key, r.child or "", r.action or "", r.n_rows, r.accepted, r.reason or "") for r in df.collect())
    assert rows(ch.cascade_delete(t, "transactions", keys(1, 1, 2, 9))) == [
        (1, "payments", "cascade", 1, True, ""), (1, "transaction_items", "cascade", 2, True, ""), (2, "transaction_items", "cascade", 1, True, ""), (9, "", "", 0, False, ch.MSG_NOT_FOUND)]
    left = ch.after_cascade(t, "transactions", keys(1, 9))
    assert {n: left[n].count() for n in ("transactions", "transaction_items", "payments")} == {"transactions": 2, "transaction_items": 1, "payments": 1}
    # both employees give treatments, employee 1 is the cashier too; without their items employee 2 may go
    refused = rows(ch.cascade_delete(t, "employees", keys(1, 2)))
    assert {(k, ok) for k, *_, ok, _ in refused} == {(1, False), (2, False)} and (1, "roles", "cascade", 1, False, ch.MSG_REFERENCED) in refused
    free = ch.after_cascade(ch.after_cascade(t, "transactions", keys(2)), "employees", keys(1, 2))
    assert [r.eid for r in free["employees"].collect()] == [1] and free["roles"].count() == 1
    assert ch.after_cascade(t, "customers", keys(1, 2))["customers"].count() == 1  # customer 1 has invoices


def test_a_refresh_of_one_day_reads_that_day_and_changes_it_alone(spark, t, tmp_path):  # noqa: F811
    from parlour.operators import management as m
    from parlour.operators import rollup as ru
    from parlour.operators import therapist as th
    from parlour.sources.tables import load_tables, save_tables

    now, path = datetime(2002, 1, 10, 12), str(tmp_path / "daily")
    begin = [now - timedelta(hours=7 * k) for k in range(60)]
    t["transactions"] = t["transactions"].withColumn("status", F.lit("paid"))
    t["payments"] = _df(spark, "payments", [(k, 1 + k % 3, ("Cash", "NETS")[k % 2], k + 1, a) for k, a in enumerate(begin)])
    t["transaction_items"] = _df(spark, "transaction_items", [item(k, 1 + k % 3, a, None, a, a, eid=1 + k % 2) for k, a in enumerate(begin)])
    ru.refresh(t, path)

    def same(t):
        rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
        for name, module in (("service_counts", m), ("revenue", m), ("payment_breakdown", m), ("therapist_period_stats", th)):
            assert rows(getattr(ru, name)(spark, t, path, now)) == rows(getattr(module, name)(t, now)), name

    same(t)
    day = date(2002, 1, 4)
    moved = {**t, "payments": t["payments"].withColumn("payment_amount", F.when(F.to_date("payment_time") == F.lit(day), F.col("payment_amount") + 100).otherwise(F.col("payment_amount"))),
             "transaction_items": t["transaction_items"].where(F.to_date("actual_start") != F.lit(day))}
    save_tables({k: moved[k] for k in ("payments", "transaction_items", "transactions")}, str(tmp_path / "facts"))
    facts = {k: spark.read.parquet(f"{tmp_path}/facts/{k}.parquet") for k in ("payments", "transaction_items", "transactions")}
    plan = ru.summed(facts, ru._in_days("payment_time", [day]), ru._in_days("actual_start", [day]))["payments"]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"DataFilters: \[isnotnull\(payment_time#\d+\), \(payment_time#\d+ >= 2002-01-04 00:00:00\), \(payment_time#\d+ < 2", plan), plan
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "daily").rglob("*.parquet")}
    ru.refresh(moved, path, [day])
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "daily").rglob("*.parquet")}
    assert {f.parent.name for f in before.items() ^ after.items() for f in [f[0]]} == {"_day=2002-01-04"}
    same(moved)


def test_sums_of_a_period_are_wider_than_one_amount(spark, t, tmp_path):  # noqa: F811
    from parlour.operators import management as m
    from parlour.operators import rollup as ru
    from parlour.operators import therapist as th

    now, path, big = datetime(2002, 1, 10, 12), str(tmp_path / "daily"), Decimal("90000000.25")
    begin = [now - timedelta(hours=20 * k) for k in range(1, 6)]
    t["transactions"] = t["transactions"].withColumn("status", F.lit("paid"))
    t["payments"] = _df(spark, "payments", [(k, 1 + k % 3, "Cash", big, a) for k, a in enumerate(begin)])
    t["transaction_items"] = _df(spark, "transaction_items", [item(k, 1 + k % 3, a, None, a, a) for k, a in enumerate(begin)]).withColumn("cost", F.lit(big).cast("decimal(10,2)"))
    ru.refresh(t, path)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for name, module in (("revenue", m), ("payment_breakdown", m), ("therapist_period_stats", th)):
        assert rows(getattr(ru, name)(spark, t, path, now)) == rows(getattr(module, name)(t, now)), name
    assert max(r.revenue for r in ru.revenue(spark, t, path, now).collect()) == 5 * big


def test_rows_of_neighbouring_keys_are_held_together(spark, tmp_path):
    keys = 3000
    for part, (seq, op) in enumerate([(5, "insert"), (5, "update"), (4, "update"), (6, "delete")]):
        rows = [("payment", k, seq, op, None if op == "delete" else k % 7, None if op == "delete" else Decimal(100 + part)) for k in range(-20, keys, 1 + part)]
        spark.createDataFrame(rows, CHANGE).repartition(3).write.mode("append").parquet(f"{tmp_path}/changes")
        sink = run_changes(spark, f"{tmp_path}/changes", str(tmp_path))
        left = [k for k in range(-20, keys) if part < 3 or (k + 20) % 4]  # equal and older seqs change nothing
        got = {r.tid: r.total_paid for r in current_totals(spark, sink).collect()}
        assert got == {d: 100 * sum(k % 7 == d for k in left) for d in range(7)}
    assert spark.read.format("statestore").load(f"{tmp_path}/_rows").count() <= keys / 1024 + 2
