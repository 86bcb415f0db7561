"""The reference's guarded single-row writes, applied to a whole batch of changes.

Each operator returns one row per requested change with ``accepted`` and a ``reason`` (the
reference's message) and, where the write changes a table, the new values. Nothing is
written: callers union/anti-join the accepted rows into their tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlour.functions.sequential import serve_in_order
from parlour.functions.temporal import add_minutes, today, ts_lit
from parlour.operators import derive as dv
from parlour.operators import slots
from parlour.operators.quality import FOREIGN_KEYS
from parlour.sources.schemas import MONEY, PAYMENT_METHOD, SCHEMAS

# The reference's messages.
MSG_END_BEFORE_START = "end date before start date"
MSG_EMPLOYMENT_ENDED = "Cannot add role: Employment has already ended."
MSG_NOT_FOUND = "not found"
MSG_STARTED_EDIT = "Cannot edit - service has already started"
MSG_STARTED_DELETE = "Cannot delete - service has already started"
MSG_SERVICE_NOT_FOUND = "Service not found"
MSG_ALREADY_STARTED = "Service already started"
MSG_NOT_STARTED = "Service hasn't started yet"
MSG_ALREADY_ENDED = "Service already ended"
MSG_NO_ENTRY = "No entry time recorded"
MSG_EXIT_RECORDED = "Exit already recorded"
MSG_DISCOUNT = "discount below zero"
MSG_COST = "cost not above zero"
MSG_AMOUNT = "malformed amount"
MSG_METHOD = "unknown payment method"
MSG_REFERENCED = "still referenced"
CONFLICT_MSG = "Customer already has a booking during this time: %s (%s - %s)"


def _end_before_start(t: dict[str, DataFrame], changes: DataFrame) -> DataFrame:
    """(eid) of changes that a CHECK refuses: the employment, or a role it would end, ends before it starts."""
    own = t["employees"].join(changes, "eid").where(F.col("new_end") < F.col("employment_start")).select("eid")
    r = t["roles"].join(changes, "eid")
    role = r.where((F.col("end_date").isNull() | (F.col("end_date") > F.col("new_end"))) & (F.col("new_end") < F.col("start_date")))
    return own.union(role.select("eid")).distinct().withColumn("_bad", F.lit(True))


def employment_end_cascade(t: dict[str, DataFrame], changes: DataFrame) -> DataFrame:
    """For ``changes(eid, new_end)``, roles with end NULL or end > new_end get end = new_end.
    No new_end: nothing changes. If the employment or any role of an employee would end before it
    starts, the whole change of that employee is rejected (the reference's CHECKs abort the statement)."""
    c = changes.where(F.col("new_end").isNotNull()).select("eid", "new_end")
    r = t["roles"].join(c, "eid").join(_end_before_start(t, c), "eid", "left")
    hit = F.col("end_date").isNull() | (F.col("end_date") > F.col("new_end"))
    rejected = F.col("_bad").isNotNull()
    return r.select(
        "rid", "eid", "rdid", "start_date", F.col("end_date").alias("old_end"),
        F.when(hit & ~rejected, F.col("new_end")).otherwise(F.col("end_date")).alias("end_date"),
        (hit & ~rejected).alias("ended"), (~rejected).alias("accepted"),
        F.when(rejected, F.lit(MSG_END_BEFORE_START)).alias("reason"))


def roles_ended_per_employee(t: dict[str, DataFrame], changes: DataFrame) -> DataFrame:
    """U1 summary: number of roles ended per changed employee (the reference's rowcount; 0 without roles)."""
    c = changes.where(F.col("new_end").isNotNull()).select("eid", "new_end")
    ended = employment_end_cascade(t, changes).where("ended").groupBy("eid").agg(F.count(F.lit(1)).alias("n"))
    j = t["employees"].select("eid").join(c, "eid").join(ended, "eid", "left").join(_end_before_start(t, c), "eid", "left")
    return j.select("eid", F.coalesce("n", F.lit(0)).alias("roles_ended"), F.col("_bad").isNull().alias("accepted"))


def end_roles(t: dict[str, DataFrame], role_ids: DataFrame, as_of) -> DataFrame:
    """Given role ids, end_date = as_of day - 1 (immediately inactive). A role that would end
    before it starts is rejected; unknown ids are reported as not found."""
    new_end = F.date_sub(F.lit(today(as_of)), 1)
    j = role_ids.select("rid").join(t["roles"], "rid", "left")
    ok = F.col("eid").isNotNull() & (new_end >= F.col("start_date"))
    return j.select(
        "rid", "eid", "start_date", F.col("end_date").alias("old_end"),
        F.when(ok, new_end).otherwise(F.col("end_date")).alias("end_date"), ok.alias("accepted"),
        F.when(F.col("eid").isNull(), F.lit(MSG_NOT_FOUND)).when(~ok, F.lit(MSG_END_BEFORE_START)).alias("reason"))


def add_roles(t: dict[str, DataFrame], requests: DataFrame, as_of) -> DataFrame:
    """``requests(req_id, eid, rdid, start_date, end_date)`` accepted unless the employee is
    unknown, employment ended on or before the as_of day, the role type is unknown, or the
    role would end before it starts."""
    d = F.lit(today(as_of))
    e = t["employees"].select("eid", "employment_end", F.lit(True).alias("_emp"))
    rd = t["role_definition"].select("rdid", F.lit(True).alias("_rd"))
    j = requests.join(e, "eid", "left").join(rd, "rdid", "left")
    reason = (F.when(F.col("_emp").isNull(), F.lit(MSG_NOT_FOUND))
              .when(F.col("employment_end").isNotNull() & (F.col("employment_end") <= d), F.lit(MSG_EMPLOYMENT_ENDED))
              .when(F.col("_rd").isNull(), F.lit("unknown role type"))
              .when(F.col("end_date") < F.col("start_date"), F.lit(MSG_END_BEFORE_START)))
    return j.select("req_id", "eid", "rdid", "start_date", "end_date", reason.isNull().alias("accepted"),
                    reason.alias("reason"))


def _conflict_text() -> F.Column:
    return F.format_string(CONFLICT_MSG, F.col("conflict_service"), F.date_format("conflict_start", "HH:mm"),
                           F.date_format("conflict_end", "HH:mm"))


def _discount() -> F.Column:
    """No discount given means none; a discount is capped at the cost."""
    return F.least(F.coalesce("item_discount", F.lit(0)).cast(MONEY), F.col("base_cost"))


def _price_reason() -> F.Column:
    """The CHECKs on an item's price."""
    return (F.when(F.col("base_cost") <= 0, F.lit(MSG_COST))
            .when(F.col("item_discount") < 0, F.lit(MSG_DISCOUNT)))


def book_items(t: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """U4: price and schedule booking requests ``(req_id, tid, sid, slot_start, therapist_eid,
    rid, item_discount, item_discount_type)``: cost = base cost, discount capped at the cost,
    end by D1. A request is rejected when the service or invoice is unknown, the price breaks a
    CHECK, or the customer has an overlapping open item (B1) or an overlapping request that was
    accepted before it (requests are served by req_id). Therapist and room are not re-checked (as
    in the reference)."""
    reqs = slots.priced_requests(t, requests)
    names = t["services"].select("sid", F.col("name").alias("_service"))
    j = reqs.join(slots._first_conflict(t, reqs), "req_id", "left").join(names, "sid", "left")
    unknown = (F.when(F.col("duration_minutes").isNull(), F.lit(MSG_SERVICE_NOT_FOUND))
               .when(F.col("cid").isNull(), F.lit("Transaction not found")))
    j = j.withColumn("_reason", F.coalesce(unknown, _price_reason()))
    none = F.lit(None).cast("timestamp_ntz")
    asked = j.where(F.col("_reason").isNull() & F.col("slot_end").isNotNull()).select(
        "req_id", F.col("cid").alias("grp"), F.col("req_id").alias("owner"), F.col("req_id").alias("party"), F.col("slot_start").alias("s"), F.col("slot_end").alias("e"),
        F.col("_service").alias("name"), F.col("conflict_ttid").isNotNull().alias("blocked"), F.lit(True).alias("holds"),
        none.alias("old_s"), none.alias("old_e"), F.lit(None).cast("string").alias("old_name"))
    return _decided(j.join(serve_in_order(asked).select("req_id", "clash"), "req_id", "left"), ["tid"])


def _decided(j: DataFrame, keys: list[str]) -> DataFrame:
    """Priced requests with the outcome: a fault, the earliest place in the way, stored (``conflict_*``) or of this batch (``clash``), or neither."""
    in_batch = F.col("clash").isNotNull() & (F.col("conflict_start").isNull() | (F.col("clash.s") < F.col("conflict_start")))
    pick = lambda own, stored: F.when(in_batch, F.col(f"clash.{own}")).otherwise(F.col(stored))
    j = j.withColumns({"conflict_service": pick("name", "conflict_service"), "conflict_end": pick("e", "conflict_end"), "conflict_start": pick("s", "conflict_start")})
    reason = F.coalesce("_reason", F.when(F.col("conflict_start").isNotNull(), _conflict_text()))
    return j.select(
        "req_id", *keys, "sid", "therapist_eid", "rid", F.col("slot_start").alias("scheduled_start"),
        F.col("slot_end").alias("scheduled_end"), F.col("base_cost").alias("cost"), _discount().alias("item_discount"),
        "item_discount_type", reason.isNull().alias("accepted"), reason.alias("reason"))


def edit_items(t: dict[str, DataFrame], edits: DataFrame) -> DataFrame:
    """Re-price and move items not yet started. ``edits(req_id, ttid, sid, slot_start,
    therapist_eid, rid, item_discount, item_discount_type)``. Rejected when the item is unknown
    or started, the service unknown, the price breaks a CHECK, or the customer has an overlap outside this invoice (B2).
    Edits are served by req_id: an item whose edit was accepted is no longer at its old place but at its new one."""
    items = t["transaction_items"]
    names = t["services"].select("sid", F.col("name").alias("_service"))
    cur = items.select("ttid", F.col("actual_start").alias("_started"), F.col("actual_end").alias("_ended"), F.col("scheduled_start").alias("_old_s"),
                       F.col("scheduled_end").alias("_old_e"), F.col("sid").alias("_old_sid"), F.lit(True).alias("_item"))
    j = slots.edit_requests_priced(t, edits).join(cur, "ttid", "left").join(names, "sid", "left")
    unknown = (F.when(F.col("_item").isNull(), F.lit("Item not found"))
               .when(F.col("_started").isNotNull(), F.lit(MSG_STARTED_EDIT))
               .when(F.col("duration_minutes").isNull(), F.lit(MSG_SERVICE_NOT_FOUND)))
    j = j.withColumn("_reason", F.coalesce(unknown, _price_reason()))
    able = j.where(F.col("_reason").isNull() & F.col("slot_end").isNotNull() & F.col("cid").isNotNull())
    still = {**t, "transaction_items": items.join(able.select("ttid").distinct(), "ttid", "left_anti")}  # stays where it is
    other = (F.col("item_tid") != F.col("tid")) & (F.col("ttid") != F.col("req_ttid"))
    conflicts = slots._first_conflict(still, able.select("req_id", "ttid", "tid", "cid", "slot_start", "slot_end"), other)
    opens = F.col("_ended").isNull()
    asked = able.join(conflicts.select("req_id", "conflict_ttid"), "req_id", "left").join(
        names.select(F.col("sid").alias("_old_sid"), F.col("_service").alias("_old_service")), "_old_sid", "left").select(
        "req_id", F.col("cid").alias("grp"), F.col("ttid").alias("owner"), F.col("tid").alias("party"), F.col("slot_start").alias("s"), F.col("slot_end").alias("e"),
        F.col("_service").alias("name"), F.col("conflict_ttid").isNotNull().alias("blocked"), opens.alias("holds"),
        F.when(opens, F.col("_old_s")).alias("old_s"), F.when(opens, F.col("_old_e")).alias("old_e"), F.col("_old_service").alias("old_name"))
    served = serve_in_order(asked).select("req_id", "clash")
    return _decided(j.join(conflicts, "req_id", "left").join(served, "req_id", "left"), ["ttid", "tid"])


def delete_items(t: dict[str, DataFrame], ttids: DataFrame) -> DataFrame:
    """Delete requested items that have not started; the others carry a reason. Of repeated requests
    for one item the first deletes it; the others no longer find it."""
    again = F.row_number().over(Window.partitionBy("ttid").orderBy("ttid")) > 1
    j = ttids.select("ttid").withColumn("_again", again).join(
        t["transaction_items"].select("ttid", "tid", "actual_start", F.lit(True).alias("_item")), "ttid", "left")
    reason = (F.when(F.col("_item").isNull(), F.lit("Item not found"))
              .when(F.col("actual_start").isNotNull(), F.lit(MSG_STARTED_DELETE))
              .when(F.col("_again"), F.lit("Item not found")))
    return j.select("ttid", "tid", reason.isNull().alias("accepted"), reason.alias("reason"))


def delete_items_totals(t: dict[str, DataFrame], ttids: DataFrame) -> DataFrame:
    """U6 effect: D2 totals of the touched invoices after the accepted deletions (the
    reference subtracts the cost a second time; D2 is taken as the definition)."""
    gone = delete_items(t, ttids).where("accepted").select("ttid", "tid")
    touched = gone.select("tid").distinct()
    items = t["transaction_items"].join(touched, "tid", "left_semi").join(gone.select("ttid"), "ttid", "left_anti")
    return dv.invoice_totals({**t, "transaction_items": items, "transactions": t["transactions"].join(touched, "tid", "left_semi")})


# The references that are deleted with their parent; all others refuse its deletion while they stand.
CASCADES = {("roles", "eid"), ("transaction_items", "tid"), ("payments", "tid"), ("refunds", "tid")}


def _key(table: str) -> str:
    return SCHEMAS[table].fieldNames()[0]


def _cascade(t: dict[str, DataFrame], table: str, keys: DataFrame) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """Level by level along the foreign keys: for each table the rows (root, key) that go with a root, and the references
    met: (root, child, fk_column, action, n_rows)."""
    gone, met = {table: keys.select(F.col("root"), F.col("root").alias("key"))}, []
    level, refusing = [table], []
    while level:
        below = []
        for child, col, parent, pcol in FOREIGN_KEYS:
            if parent not in level:
                continue
            refs = t[child].select(F.col(_key(child)).alias("child_key"), F.col(col).alias("key")).join(gone[parent], "key").select("root", F.col("child_key").alias("key"))
            if (child, col) in CASCADES:
                gone[child] = refs if child not in gone else gone[child].unionByName(refs).distinct()
                below.append(child)
                met.append(_counted(refs, child, col, "cascade"))
            else:
                refusing.append((child, col, refs))
        level = below
    for child, col, refs in refusing:  # rows that go themselves refuse nothing
        met.append(_counted(refs.join(gone[child], ["root", "key"], "left_anti") if child in gone else refs, child, col, "restrict"))
    return gone, met


def _counted(refs: DataFrame, child: str, col: str, action: str) -> DataFrame:
    return refs.groupBy("root").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "root", F.lit(child).alias("child"), F.lit(col).alias("fk_column"), F.lit(action).alias("action"), "n_rows")


def cascade_delete(t: dict[str, DataFrame], table: str, keys: DataFrame) -> DataFrame:
    """U6 for parents: deleting the rows ``keys`` (key) of ``table``. A row a requested key and foreign key met: child,
    fk_column, action, n_rows (rows that go with it, or that refuse it), accepted, reason; one row without a child if no
    reference is met. A key is refused if it is unknown or rows that do not go with it refer to it. Repeated keys count once."""
    roots = keys.select(F.col(keys.columns[0]).alias("root")).distinct()
    _, met = _cascade(t, table, roots)
    refs = reduce(DataFrame.unionByName, met) if met else None
    known = t[table].select(F.col(_key(table)).alias("root"), F.lit(True).alias("_known"))
    j = roots.join(known, "root", "left")
    if refs is None:
        j = j.withColumns({c: F.lit(None).cast("string") for c in ("child", "fk_column", "action")}).withColumn("n_rows", F.lit(None).cast("long"))
    else:
        j = j.join(refs, "root", "left")
    refused = F.bool_or(F.coalesce(F.col("action") == "restrict", F.lit(False))).over(Window.partitionBy("root"))
    reason = F.when(F.col("_known").isNull(), F.lit(MSG_NOT_FOUND)).when(refused, F.lit(MSG_REFERENCED))
    return j.select(F.col("root").alias("key"), "child", "fk_column", "action", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"),
                    reason.isNull().alias("accepted"), reason.alias("reason"))


def after_cascade(t: dict[str, DataFrame], table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """The tables without the accepted rows of ``keys`` and all that goes with them."""
    accepted = cascade_delete(t, table, keys).where("accepted").select(F.col("key").alias("root")).distinct()
    gone, _ = _cascade(t, table, accepted)
    return {**t, **{name: t[name].join(rows.select(F.col("key").alias(_key(name))).distinct(), _key(name), "left_anti").select(*t[name].columns) for name, rows in gone.items()}}


def service_clock(t: dict[str, DataFrame], events: DataFrame) -> DataFrame:
    """Apply ``events(event_id, ttid, kind in {'start','end'}, event_time)`` in (event_time, event_id)
    order per item: a start needs no actual_start; an end needs a start and no actual_end.

    Events and items meet in one shuffle by item; the windows that follow keep that partitioning."""
    items = t["transaction_items"].select("ttid", "actual_start", "actual_end", F.lit(True).alias("_item_known"))
    ev = events.join(items, "ttid", "left").withColumn("_pos", F.struct("event_time", "event_id"))
    of_item = Window.partitionBy("ttid")
    s0, found = F.col("actual_start").isNotNull(), F.col("_item_known").isNotNull()
    ev = ev.withColumn("_first_start", F.min(F.when(F.col("kind") == "start", F.col("_pos"))).over(of_item))
    start_ok = (F.col("kind") == "start") & ~s0 & (F.col("_pos") == F.col("_first_start")) & found
    started = s0 | (F.col("_first_start").isNotNull() & (F.col("_pos") > F.col("_first_start")))
    end_cand = (F.col("kind") == "end") & started & F.col("actual_end").isNull()
    ev = ev.withColumn("_first_end", F.min(F.when(end_cand, F.col("_pos"))).over(of_item))
    end_ok = end_cand & (F.col("_pos") == F.col("_first_end"))
    reason = (F.when(~found, F.lit("Service not found"))
              .when(start_ok | end_ok, F.lit(None))
              .when(F.col("kind") == "start", F.lit(MSG_ALREADY_STARTED))
              .when(~started, F.lit(MSG_NOT_STARTED))
              .otherwise(F.lit(MSG_ALREADY_ENDED)))
    return ev.select("event_id", "ttid", "kind", "event_time", reason.isNull().alias("accepted"), reason.alias("reason"))


def service_clock_items(t: dict[str, DataFrame], events: DataFrame) -> DataFrame:
    """U7 effect: the new actual_start / actual_end of every item touched by an accepted event."""
    dec = service_clock(t, events).where("accepted")
    upd = dec.groupBy("ttid").agg(F.min(F.when(F.col("kind") == "start", F.col("event_time"))).alias("new_start"),
                                  F.min(F.when(F.col("kind") == "end", F.col("event_time"))).alias("new_end"))
    j = upd.join(t["transaction_items"].select("ttid", "actual_start", "actual_end"), "ttid")
    return j.select("ttid", F.coalesce("new_start", "actual_start").alias("actual_start"),
                    F.coalesce("new_end", "actual_end").alias("actual_end"))


def payment_intake(t: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """U8: ``requests(req_id, tid, methods array<string>, amounts array<string>, event_time)`` -> one
    payment per (method, amount) pair, pairs cut at the shorter list (like Python's zip), amounts <= 0
    left out. A malformed or too large amount, an unknown method or an unknown invoice rejects all
    payments of its request, and of no other; ``reason`` is that of the first pair that fails."""
    n = F.least(F.size("methods"), F.size("amounts"))
    pairs = requests.select("req_id", "tid", "event_time", F.posexplode(F.arrays_zip("methods", "amounts")).alias("pos", "p"),
                            n.alias("_n"))
    pairs = pairs.where(F.col("pos") < F.col("_n")).select(
        "req_id", "tid", F.col("pos").cast("long").alias("pos"), F.col("p.methods").alias("payment_method"),
        F.col("p.amounts").try_cast("double").alias("_amt"), F.col("event_time").alias("payment_time"))
    known = t["transactions"].select("tid", F.lit(True).alias("_tx"))
    pays = F.col("_amt") > 0
    fault = (F.when(F.col("_amt").isNull() | (pays & (F.isnan("_amt") | (F.abs("_amt") >= 1e8))), F.lit(MSG_AMOUNT))
             .when(pays & ~F.coalesce(F.col("payment_method").isin(*PAYMENT_METHOD), F.lit(False)), F.lit(MSG_METHOD))
             .when(pays & F.col("_tx").isNull(), F.lit("Transaction not found")))
    j = pairs.join(known, "tid", "left").withColumn("_fault", fault)
    first = F.min(F.when(F.col("_fault").isNotNull(), F.struct("pos", "_fault"))).over(Window.partitionBy("req_id"))
    j = j.withColumn("reason", first["_fault"]).where(pays | F.col("_amt").isNull())
    return j.select("req_id", "tid", "pos", "payment_method", F.when(F.abs("_amt") < 1e8, F.col("_amt")).cast(MONEY).alias("payment_amount"),
                    "payment_time", F.col("reason").isNull().alias("accepted"), "reason")


def payment_intake_status(t: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """U8 effect: per paid invoice the new total_paid (D4), status (D5) and, when nothing is
    outstanding and the exit is recorded, 'completed' (D6)."""
    new = payment_intake(t, requests).where("accepted")
    pays = t["payments"].select("tid", "payment_amount").unionByName(new.select("tid", "payment_amount"))
    touched = new.select("tid").distinct()
    tx = t["transactions"].join(touched, "tid", "left_semi")
    paid = pays.join(touched, "tid", "left_semi").groupBy("tid").agg(F.sum("payment_amount").alias("_p"))
    refunded = t["refunds"].join(touched, "tid", "left_semi").groupBy("tid").agg(F.sum("refund_amount").alias("_r"))
    j = tx.join(paid, "tid", "left").join(refunded, "tid", "left")
    total_paid = (F.coalesce("_p", F.lit(0).cast(MONEY)) - F.coalesce("_r", F.lit(0).cast(MONEY))).cast(MONEY)
    j = j.withColumn("total_paid", total_paid)
    st = dv.status_rule(F.col("status"), F.col("total_cost"), F.col("total_discount"), F.col("total_paid"))
    out = dv.outstanding_col(F.col("total_cost"), F.col("total_discount"), F.col("total_paid"))
    final = F.when((out <= 0) & F.col("exit_time").isNotNull() & (st != "completed"), F.lit("completed")).otherwise(st)
    return j.select("tid", "total_paid", out.alias("outstanding"), final.alias("status"))


def record_exit(t: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """``requests(tid, event_time)``, served by time, set exit_time on invoices with an entry and no exit; status
    becomes 'completed' when nothing is outstanding, else the payment-state rule (D5) applies."""
    tx = t["transactions"].select("tid", "entry_time", "exit_time", "total_cost", "total_discount", "total_paid",
                                  "status", F.lit(True).alias("_tx"))
    by_time = Window.partitionBy("tid").orderBy("event_time")
    asked = requests.select("tid", "event_time", (F.row_number().over(by_time) > 1).alias("_again"), F.min("event_time").over(by_time).alias("_first"))
    j = asked.join(tx, "tid", "left")
    refused = (F.when(F.col("_tx").isNull(), F.lit("Transaction not found"))
               .when(F.col("entry_time").isNull(), F.lit(MSG_NO_ENTRY))
               .when(F.col("exit_time").isNotNull(), F.lit(MSG_EXIT_RECORDED)))
    reason = F.coalesce(refused, F.when(F.col("_again"), F.lit(MSG_EXIT_RECORDED)))
    owed = F.col("total_cost") - F.col("total_discount") - F.col("total_paid")
    new_status = F.when(owed <= 0, F.lit("completed")).otherwise(
        dv.status_rule(F.col("status"), F.col("total_cost"), F.col("total_discount"), F.col("total_paid")))
    left = refused.isNull()  # the invoice leaves with the first of its requests
    return j.select("tid", reason.isNull().alias("accepted"), reason.alias("reason"),
                    F.when(left, F.col("_first")).otherwise(F.col("exit_time")).alias("exit_time"),
                    F.when(left, new_status).otherwise(F.col("status")).alias("status"))
