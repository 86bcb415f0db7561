"""Conflicts and candidate therapists/rooms for a table of slot requests.

Requests: ``(req_id, tid, sid, slot_start)`` for new bookings, or the item being edited
``(req_id, ttid, tid, ...)``. Overlap is open (``start < slot_end and end > slot_start``)
and only items not yet ended block a slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlour.functions.bitmaps import is_set, listed_sets, member_sets, overlapping_sets, page_of
from parlour.functions.intervals import envelope_filter, overlap_pairs
from parlour.functions.temporal import add_minutes, employed, role_active, today
from parlour.session import kept


def priced_requests(t: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Requests with the customer, slot end (D1 rule), required role and price of the service."""
    s = t["services"].select("sid", "duration_minutes", "base_cost", F.col("rdid").alias("req_rdid"))
    r = requests.join(t["transactions"].select("tid", "cid"), "tid", "left").join(s, "sid", "left")
    return r.withColumn("slot_end", add_minutes(F.col("slot_start"), F.col("duration_minutes")))


def _open_items(t: dict[str, DataFrame]) -> DataFrame:
    return t["open_items"] if "open_items" in t else t["transaction_items"].where(F.col("actual_end").isNull())


def _with_open(t: dict[str, DataFrame], item_key: str) -> dict[str, DataFrame]:
    """``t`` with the open items' times and resource written once in the shared folder, where each use would go through all items."""
    return t | {"open_items": kept(_open_items(t).select("ttid", item_key, "scheduled_start", "scheduled_end"))}


def _first_conflict(t, reqs: DataFrame, extra=None) -> DataFrame:
    items = envelope_filter(_open_items(t), "scheduled_start", "scheduled_end", reqs, "slot_start", "slot_end")
    items = items.select("ttid", F.col("tid").alias("item_tid"), "sid", "scheduled_start", "scheduled_end").join(
        t["transactions"].select(F.col("tid").alias("item_tid"), "cid"), "item_tid")
    left = reqs.select("req_id", "cid", "slot_start", "slot_end", *(["tid", F.col("ttid").alias("req_ttid")]
                                                                    if "ttid" in reqs.columns else ["tid"]))
    pairs = overlap_pairs(left, items, ["cid"], ("slot_start", "slot_end"), ("scheduled_start", "scheduled_end"),
                          extra)
    first = pairs.groupBy("req_id").agg(F.min(F.struct("scheduled_start", "ttid", "sid", "scheduled_end")).alias("c"))
    first = first.select("req_id", F.col("c.ttid").alias("conflict_ttid"), F.col("c.sid").alias("conflict_sid"),
                         F.col("c.scheduled_start").alias("conflict_start"), F.col("c.scheduled_end").alias("conflict_end"))
    return first.join(t["services"].select(F.col("sid").alias("conflict_sid"), F.col("name").alias("conflict_service")),
                      "conflict_sid", "left").drop("conflict_sid")


def customer_conflicts(t: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """B1: per request, the customer's earliest open item overlapping the slot (if any)."""
    return _first_conflict(t, priced_requests(t, requests))


def edit_requests_priced(t: dict[str, DataFrame], edits: DataFrame) -> DataFrame:
    """Edit requests ``(req_id, ttid, sid, slot_start, ...)`` with tid and customer of the item."""
    e = edits.join(t["transaction_items"].select("ttid", "tid"), "ttid", "left")
    return priced_requests(t, e)


def edit_conflicts(t: dict[str, DataFrame], edits: DataFrame) -> DataFrame:
    """B2: as B1 for an edited item, ignoring items of the same invoice and the item itself."""
    reqs = edit_requests_priced(t, edits)
    extra = (F.col("item_tid") != F.col("tid")) & (F.col("ttid") != F.col("req_ttid"))
    return _first_conflict(t, reqs, extra)


SALTS = 16
CHUNK = 32  # requests of a slot that are listed together: with a page's entries they make the rows that a task holds at a time


def _slots(reqs: DataFrame, *others: str) -> DataFrame:
    return reqs.select("slot_start", "slot_end", *others).distinct()


def busy_sets(t: dict[str, DataFrame], slots: DataFrame, item_key: str) -> DataFrame:
    """(slot_start, slot_end, page, busy) for ``slots`` (slot_start, slot_end, page): the page's resources that an open item takes
    in the slot, as a bitmap; a slot and page without any has no row."""
    items = envelope_filter(_open_items(t), "scheduled_start", "scheduled_end", slots, "slot_start", "slot_end")
    items = items.select(F.col(item_key).cast("long").alias("key"), F.col("scheduled_start").alias("start"), F.col("scheduled_end").alias("end"))
    return overlapping_sets(slots, items)


def page_sets(t: dict[str, DataFrame], slots: DataFrame, pages: DataFrame, item_key: str) -> DataFrame:
    """``slots`` (slot_start, slot_end, cls, ...) a page of their class in ``pages`` (cls, page), with the bitmap of what is busy
    there (null: nothing is). Slots and pages meet by class, dealt over SALTS parts, as a class may be that of all slots."""
    pages = pages.select("cls", "page").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.xxhash64("slot_start", "slot_end"), F.lit(SALTS)).cast("int")
    asked = slots.withColumn("salt", spread).join(pages, ["cls", "salt"]).drop("salt")
    return asked.join(busy_sets(t, _slots(asked, "page"), item_key), ["slot_start", "slot_end", "page"], "left")  # a slot without a bound has nothing busy


def _dealt(held: DataFrame, pages: DataFrame, spread: list[str], salts: int) -> DataFrame:
    """``held`` with what ``pages`` says of its class and page. It is sent once a salt, and the parts are of a fixed number, as
    what comes of a part is far more than what is shuffled. The key is one column: a class that is the same for all would
    else fall out of the join, which would shuffle again."""
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct("cls", "page", "salt").alias("_key")
    held = held.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).select("*", key).drop("salt").repartition(parts, "_key")
    pages = pages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("*", key).drop("cls", "page", "salt")
    return held.join(pages, "_key").drop("_key")


def free_sets(t: dict[str, DataFrame], slots: DataFrame, members: DataFrame, item_key: str, salts: int = SALTS) -> DataFrame:
    """(slot_start, slot_end, cls, page, members, busy): for each distinct slot of a class the class's resources and what of them
    is busy (null: nothing), as bitmaps a page; ``free_set_rows`` lists the rest.

    ``slots``: (slot_start, slot_end, cls); ``members``: (cls, page, members). The answer has a row a distinct slot, class and
    page of identifiers, whatever the number of requests. A class's pages are sent to ``salts`` parts: fewer where there are
    many classes of few slots each."""
    return _dealt(page_sets(t, _slots(slots, "cls"), members, item_key), members, ["slot_start", "slot_end"], salts)


def _asked_by(links: DataFrame) -> DataFrame:
    """(slot_start, slot_end, cls, chunk, reqs): some CHUNK of the requests that ask for a slot, in a list."""
    each = links.select("req_id", "slot_start", "slot_end", "cls").distinct()
    n = each.groupBy(F.col("slot_start").alias("n_start"), F.col("slot_end").alias("n_end"), F.col("cls").alias("n_cls")).agg(F.count(F.lit(1)).alias("n"))
    on = F.col("slot_start").eqNullSafe(F.col("n_start")) & F.col("slot_end").eqNullSafe(F.col("n_end")) & (F.col("cls") == F.col("n_cls"))
    chunk = F.pmod(F.xxhash64("req_id"), F.ceil(F.col("n") / CHUNK)).alias("chunk")
    none = F.when(F.bool_or(F.col("req_id").isNull()), F.array(F.lit(None).cast(dict(each.dtypes)["req_id"])))
    reqs = F.concat(F.collect_list("req_id"), F.coalesce(none, F.array().cast(f"array<{dict(each.dtypes)['req_id']}>")))
    return each.join(n, on).select("req_id", "slot_start", "slot_end", "cls", chunk).groupBy("slot_start", "slot_end", "cls", "chunk").agg(reqs.alias("reqs"))


def _listed(t: dict[str, DataFrame], links: DataFrame, resources: DataFrame, item_key: str) -> DataFrame:
    """The free resources of every request. The requests for a slot go together, some CHUNK at a time, with the bitmap of what is
    busy in each of its pages; they meet the page's entries last, so that what is shuffled is a bitmap a chunk and page, and
    an entry is looked at once a chunk."""
    labels = [c for c in resources.columns if c != "cls"]
    resources = resources.withColumn("page", page_of(F.col("key"))).where(F.col("key").isNotNull())
    entries = resources.groupBy("cls", "page").agg(F.sort_array(F.collect_set(F.struct(*labels))).alias("entries"))
    held = page_sets(t, _asked_by(links), resources, item_key)
    each = _dealt(held, entries, ["slot_start", "slot_end", "chunk"], SALTS).select("reqs", "busy", F.explode("entries").alias("e"))
    return each.where(~is_set(F.col("busy"), F.col("e.key").cast("long"))).select(F.explode("reqs").alias("req_id"), "e")


def staff_of_role(t: dict[str, DataFrame], as_of, inclusive: bool, by_role: bool) -> DataFrame:
    """(cls, key, work_name, role_type) of the employees on duty; the class is the role, or 0 for all."""
    d = today(as_of)
    e = t["employees"].where(employed(F.col("employment_end"), d, inclusive)).select("eid", "work_name")
    r = t["roles"].where(role_active(F.col("start_date"), F.col("end_date"), d)).select("eid", "rdid")
    cls = F.col("rdid") if by_role else F.lit(0)
    return e.join(r, "eid").join(t["role_definition"], "rdid").select(cls.alias("cls"), F.col("eid").alias("key"), "work_name", "role_type").distinct()


def _rooms(t: dict[str, DataFrame]) -> DataFrame:
    return t["room"].select(F.lit(0).alias("cls"), F.col("rid").alias("key"), "room_name")


def therapist_links(t: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """(req_id, slot_start, slot_end, cls): the slot and the role that a request asks for."""
    return priced_requests(t, requests).select("req_id", "slot_start", "slot_end", F.col("req_rdid").alias("cls"))


def room_links(t: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    return priced_requests(t, requests).select("req_id", "slot_start", "slot_end", F.lit(0).alias("cls"))


def edit_links(t: dict[str, DataFrame], edits: DataFrame, item_key: str) -> DataFrame:
    """(req_id, slot_start, slot_end, cls, own): an edit's slot is the item's stored schedule. ``own`` is the item's resource
    where this item alone keeps it busy: it is free to this edit though it is not in the slot's free set."""
    stored = t["transaction_items"].select(
        F.col("ttid").alias("req_ttid"), F.col("scheduled_start").alias("slot_start"), F.col("scheduled_end").alias("slot_end"),
        F.when(F.col("actual_end").isNull() & (F.col("scheduled_start") < F.col("scheduled_end")), F.col(item_key)).alias("key"))
    asked = kept(edits.select("req_id", F.col("ttid").alias("req_ttid")))  # first, as edits may be made of the items: one pass on disk at a time
    e = kept(asked.join(stored, "req_ttid"))
    held = e.where(F.col("key").isNotNull())
    items = envelope_filter(_open_items(t), "scheduled_start", "scheduled_end", held, "slot_start", "slot_end")
    items = items.select(F.col(item_key).alias("key"), "ttid", "scheduled_start", "scheduled_end")
    others = overlap_pairs(held, items, ["key"], ("slot_start", "slot_end"), ("scheduled_start", "scheduled_end"), F.col("ttid") != F.col("req_ttid"))
    taken = others.select("req_id", "req_ttid").distinct().withColumn("_taken", F.lit(True))
    return e.join(taken, ["req_id", "req_ttid"], "left").select(
        "req_id", "slot_start", "slot_end", F.lit(0).alias("cls"), F.when(F.col("_taken").isNull(), F.col("key")).alias("own"))


def _with_own(t: dict[str, DataFrame], links: DataFrame, resources: DataFrame, item_key: str) -> DataFrame:
    entry = F.struct(*[c for c in resources.columns if c != "cls"])
    own = links.where(F.col("own").isNotNull()).select("req_id", F.col("own").alias("key")).distinct().join(resources, "key").select("req_id", entry.alias("e"))
    return _listed(t, links, resources, item_key).unionByName(own)


def candidate_therapists(t: dict[str, DataFrame], requests: DataFrame, as_of) -> DataFrame:
    """Employees holding exactly the service's role (employed, exclusive) and free in the slot."""
    t, links = _with_open(t, "therapist_eid"), kept(therapist_links(t, requests))
    staff = staff_of_role(t, as_of, inclusive=False, by_role=True)
    return _listed(t, links, staff, "therapist_eid").select("req_id", F.col("e.key").alias("eid"), "e.work_name", "e.role_type")


def candidate_rooms(t: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Rooms with no open item overlapping the slot."""
    t, links = _with_open(t, "rid"), kept(room_links(t, requests))
    return _listed(t, links, _rooms(t), "rid").select("req_id", F.col("e.key").alias("rid"), "e.room_name")


def edit_candidate_therapists(t: dict[str, DataFrame], edits: DataFrame, as_of) -> DataFrame:
    """Any employee with an active role (employed, inclusive) free in the item's slot, the item itself aside."""
    t = _with_open(t, "therapist_eid")
    links, staff = kept(edit_links(t, edits, "therapist_eid")), staff_of_role(t, as_of, inclusive=True, by_role=False)
    found = _with_own(t, links, staff, "therapist_eid")
    return found.select("req_id", F.col("e.key").alias("eid"), "e.work_name", "e.role_type")


def edit_candidate_rooms(t: dict[str, DataFrame], edits: DataFrame) -> DataFrame:
    """Rooms free in the item's slot, ignoring the item itself."""
    t = _with_open(t, "rid")
    links = kept(edit_links(t, edits, "rid"))
    return _with_own(t, links, _rooms(t), "rid").select("req_id", F.col("e.key").alias("rid"), "e.room_name")


def free_set_rows(free: DataFrame) -> DataFrame:
    """The free sets as plain rows: identifiers ascending, each once, joined by commas, and their number."""
    return listed_sets(free, ["slot_start", "slot_end", "cls"])


def therapist_slot_sets(t: dict[str, DataFrame], requests: DataFrame, as_of) -> DataFrame:
    """B3 a distinct slot and role instead of a request; ``therapist_links`` says which requests ask for it."""
    t, links = _with_open(t, "therapist_eid"), kept(therapist_links(t, requests))
    return free_set_rows(free_sets(t, links, member_sets(staff_of_role(t, as_of, inclusive=False, by_role=True)), "therapist_eid"))


def room_slot_sets(t: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """B4 a distinct slot instead of a request."""
    t, links = _with_open(t, "rid"), kept(room_links(t, requests))
    return free_set_rows(free_sets(t, links, member_sets(_rooms(t)), "rid"))


def edit_therapist_slot_sets(t: dict[str, DataFrame], edits: DataFrame, as_of) -> DataFrame:
    """B5 a distinct slot instead of an edit; ``edit_links`` adds to each edit what only its own item keeps busy."""
    t = _with_open(t, "therapist_eid")
    links = kept(edit_links(t, edits, "therapist_eid"))
    return free_set_rows(free_sets(t, links, member_sets(staff_of_role(t, as_of, inclusive=True, by_role=False)), "therapist_eid"))


def edit_room_slot_sets(t: dict[str, DataFrame], edits: DataFrame) -> DataFrame:
    """B6 a distinct slot instead of an edit."""
    t = _with_open(t, "rid")
    return free_set_rows(free_sets(t, kept(edit_links(t, edits, "rid")), member_sets(_rooms(t)), "rid"))
