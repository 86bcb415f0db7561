"""Derive the eleven domain tables from the driver's TPC-H-style tables.

The rules (FIXTURES.md §3) are deterministic functions of the input rows, so the same tables
come out of :mod:`parlour.plans.oracle` in DuckDB. Everything here is lazy: an operator that
touches only ``payments`` never scans ``lineitem``.

Scale notes: the only shuffles are the per-order line numbering (``lineitem`` hashed on
``l_orderkey``), the join of items to services on ``sid`` (AQE turns it into a broadcast only
when the runtime size of ``services`` is under the broadcast threshold) and the per-order
aggregates that feed the stored invoice totals.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlour.functions.temporal import add_hours, add_minutes
from parlour.sources.schemas import MONEY, PAYMENT_METHOD
from parlour.sources.tables import conform

# Fixed values of the fixture calendar.
AS_OF = datetime(2000, 6, 14, 12, 0, 0)
OPENING = date(1995, 1, 1)
CALENDAR_START = datetime(2000, 2, 15)
# Role types of role_definition, by rdid.
ROLE_TYPES = ("Senior Therapist", "Beautician", "Doctor", "Cashier", "Manager")

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


_RAW_CACHE: dict[tuple[str, str], dict[str, DataFrame]] = {}


def read_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The driver tables (lazy scans; file listing and footers are read once per session)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RAW_CACHE:
        _RAW_CACHE[key] = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in RAW_TABLES}
    return _RAW_CACHE[key]


def _code(c) -> F.Column:
    return F.lpad(c.cast("string"), 2, "0")


def _ts(v: datetime) -> F.Column:
    return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")


def _method(key: F.Column) -> F.Column:
    m = F.when(key % 6 == 0, PAYMENT_METHOD[0])
    for i, name in enumerate(PAYMENT_METHOD[1:], start=1):
        m = m.when(key % 6 == i, name)
    return m


def role_definition(spark: SparkSession) -> DataFrame:
    return conform(spark.createDataFrame(list(enumerate(ROLE_TYPES)), "rdid int, role_type string"), "role_definition")


def nationcode(raw) -> DataFrame:
    n = raw["nation"]
    return conform(n.select(_code(n.n_nationkey).alias("country_code"), n.n_name.alias("country_name"),
                            n.n_name.alias("default_nationality")), "nationcode")


def room(raw) -> DataFrame:
    n = raw["nation"]
    return conform(n.select(n.n_nationkey.alias("rid"), n.n_name.alias("room_name")), "room")


def customers(raw) -> DataFrame:
    c = raw["customer"]
    return conform(c.select(
        c.c_custkey.alias("cid"),
        F.concat(F.lit("S"), c.c_custkey.cast("string")).alias("nric_fin_passport_no"),
        c.c_name.alias("name"),
        F.when(c.c_custkey % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.lpad(((c.c_custkey * 7919) % 100000000).cast("string"), 8, "0").alias("mobile_number"),
        _code(c.c_nationkey).alias("country_code"),
    ), "customers")


def employees(raw) -> DataFrame:
    s = raw["supplier"]
    eid = s.s_suppkey
    return conform(s.select(
        eid.alias("eid"),
        F.concat(F.lit("E"), eid.cast("string")).alias("nric_fin_passport_no"),
        F.replace(s.s_name, F.lit("Supplier#"), F.lit("Staff ")).alias("name"),
        s.s_name.alias("work_name"),
        F.when(eid % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.lpad(((eid * 7907) % 100000000).cast("string"), 8, "0").alias("mobile_number"),
        _code(s.s_nationkey).alias("country_code"),
        F.lit(OPENING).alias("employment_start"),
        F.when(eid % 9 == 4, F.lit(date(2000, 6, 14))).when(eid % 9 == 7, F.lit(date(1999, 12, 31))).alias("employment_end"),
        _ts(datetime(1995, 1, 1, 9)).alias("created_at"),
        _ts(datetime(1995, 1, 1, 9)).alias("updated_at"),
    ), "employees")


def roles(raw) -> DataFrame:
    eid = raw["supplier"].s_suppkey
    a = raw["supplier"].select(
        (eid * 2).alias("rid"), eid.alias("eid"), (eid % 5).cast("int").alias("rdid"), F.lit(OPENING).alias("start_date"),
        F.when(eid % 11 == 3, F.lit(date(2000, 6, 14))).alias("end_date"))
    b = raw["supplier"].where(eid % 4 == 0).select(
        (eid * 2 + 1).alias("rid"), eid.alias("eid"), ((eid + 1) % 5).cast("int").alias("rdid"),
        F.lit(date(1998, 1, 1)).alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return conform(a.unionByName(b), "roles")


def services(raw) -> DataFrame:
    p = raw["part"]
    sid = p.p_partkey
    return conform(p.select(
        sid.alias("sid"), p.p_name.alias("name"), F.concat_ws(" ", p.p_brand, p.p_type).alias("description"),
        (30 * (1 + p.p_size % 8)).alias("duration_minutes"), p.p_retailprice.cast(MONEY).alias("base_cost"),
        F.lit(OPENING).alias("active_from"),
        F.when(sid % 10 == 3, F.lit(date(2000, 6, 13))).when(sid % 10 == 4, F.lit(date(2000, 6, 14))).alias("active_until"),
        (p.p_size % 5).cast("int").alias("rdid"),
    ), "services")


def transaction_items(raw, svc: DataFrame) -> DataFrame:
    li = raw["lineitem"]
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus")
    x = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate",
        F.row_number().over(w).alias("seq"))
    x = x.join(svc.select(F.col("sid").alias("l_partkey"), "duration_minutes"), "l_partkey", "left")
    as_of = _ts(AS_OF)
    sched = add_minutes(add_hours(
        F.date_add(F.lit(CALENDAR_START.date()), (F.datediff(F.col("l_shipdate"), F.lit(OPENING)) % 128).cast("int"))
        .cast("timestamp_ntz"), 9 + F.col("l_partkey") % 12), 5 * F.col("l_linenumber"))
    x = x.withColumn("scheduled_start", sched)
    tid_seq = F.col("l_orderkey") + F.col("seq")
    start_try = add_minutes(F.col("scheduled_start"), 2 * (F.col("l_linenumber") % 3))
    x = x.withColumn("actual_start", F.when(
        (F.col("scheduled_start") <= as_of) & (tid_seq % 50 != 0) & (start_try <= as_of), start_try))
    end_try = add_minutes(F.col("actual_start"), F.col("duration_minutes") + 3 * (F.col("l_linenumber") - 4))
    x = x.withColumn("actual_end", F.when(
        (end_try <= as_of) & ~((F.col("l_suppkey") % 3 == 0) & (tid_seq % 40 == 3)), end_try))
    cost = F.col("l_extendedprice").cast(MONEY)
    return conform(x.select(
        (F.col("l_orderkey") * 1000 + F.col("seq")).alias("ttid"),
        F.col("l_orderkey").alias("tid"), F.col("l_partkey").alias("sid"), F.col("l_suppkey").alias("therapist_eid"),
        "scheduled_start",
        add_minutes(F.col("scheduled_start"), F.col("duration_minutes")).alias("scheduled_end"),
        "actual_start", "actual_end",
        cost.alias("cost"),
        (cost * F.col("l_discount").cast("decimal(3,2)")).cast(MONEY).alias("item_discount"),
        F.when(F.col("l_discount") > 0, "promo").otherwise("none").alias("item_discount_type"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 20).alias("rid"),
    ), "transaction_items")


def payments(raw) -> DataFrame:
    o = raw["orders"]
    tid = o.o_orderkey
    return conform(o.where(tid % 7 != 0).select(
        (tid * 2).alias("pid"), tid.alias("tid"), _method(tid).alias("payment_method"),
        (o.o_totalprice.cast(MONEY) * F.when(tid % 4 == 0, F.lit(0.5).cast("decimal(2,1)"))
         .otherwise(F.lit(1.0).cast("decimal(2,1)"))).cast(MONEY).alias("payment_amount"),
        add_hours(o.o_orderdate, 10 + tid % 10).alias("payment_time"),
    ), "payments")


def refunds(raw) -> DataFrame:
    o = raw["orders"]
    tid = o.o_orderkey
    return conform(o.where((o.o_orderstatus != "F") & (tid % 10 == 0) & (tid % 7 != 0)).select(
        tid.alias("refid"), tid.alias("tid"), _method(tid).alias("refund_method"),
        (o.o_totalprice.cast(MONEY) * F.lit(0.5).cast("decimal(2,1)")).cast(MONEY).alias("refund_amount"),
        F.lit("service not delivered").alias("refund_reason"),
        add_hours(o.o_orderdate, 34 + tid % 10).alias("refund_time"),
    ), "refunds")


def transactions(raw, items: DataFrame, payments: DataFrame, refunds: DataFrame) -> DataFrame:
    """Invoice headers with the totals as the triggers keep them: per-tid aggregates joined straight onto the orders (no
    self join), so Catalyst drops each join when its columns are not read. One aggregate of the items tells both their
    sums and whether there are any."""
    money0 = F.lit(0).cast(MONEY)
    o = raw["orders"]
    tid = o.o_orderkey
    item_sums = items.groupBy(F.col("tid").alias("o_orderkey")).agg(F.sum("cost").alias("_c"), F.sum("item_discount").alias("_d"))
    paid = payments.groupBy(F.col("tid").alias("o_orderkey")).agg(F.sum("payment_amount").alias("_p"))
    refunded = refunds.groupBy(F.col("tid").alias("o_orderkey")).agg(F.sum("refund_amount").alias("_r"))
    o = (o.join(item_sums.withColumn("_has", F.lit(True)), "o_orderkey", "left")
         .join(paid, "o_orderkey", "left").join(refunded, "o_orderkey", "left"))
    created = add_hours(o.o_orderdate, 9 + tid % 10)
    status = (F.when(o.o_orderstatus == "F", "completed").when(tid % 10 == 0, "refunded").when(tid % 10 == 1, "cancelled")
              .when(o.o_orderstatus == "P", "paid").when(tid % 2 == 0, "partial").otherwise("pending"))
    bill = F.when((tid % 8 == 0) & F.col("_has").isNotNull(), F.lit(5).cast(MONEY)).otherwise(F.lit(0).cast(MONEY))
    return conform(o.select(
        tid.alias("tid"), o.o_custkey.alias("cid"), (tid % 10).alias("cashier_eid"),
        bill.alias("billlevel_discount"),
        F.when(bill > 0, "promo").otherwise("none").alias("billlevel_discount_type"),
        F.coalesce("_c", money0).alias("total_cost"), (F.coalesce("_d", money0) + bill).alias("total_discount"),
        (F.coalesce("_p", money0) - F.coalesce("_r", money0)).alias("total_paid"),
        F.when(tid % 97 != 0, created).alias("entry_time"),
        F.when((o.o_orderstatus != "O") & (tid % 97 != 0), add_hours(o.o_orderdate, 11 + tid % 10)).alias("exit_time"),
        status.alias("status"), created.alias("created_at"), created.alias("updated_at"),
    ), "transactions")


def derive_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The eleven domain tables, with invoice totals as the reference's triggers keep them."""
    raw = read_raw(spark, sf_dir)
    t = {
        "role_definition": role_definition(spark),
        "nationcode": nationcode(raw),
        "room": room(raw),
        "customers": customers(raw),
        "employees": employees(raw),
        "roles": roles(raw),
        "services": services(raw),
    }
    t["transaction_items"] = transaction_items(raw, t["services"])
    t["payments"] = payments(raw)
    t["refunds"] = refunds(raw)
    t["transactions"] = transactions(raw, t["transaction_items"], t["payments"], t["refunds"])
    return t
