"""Declared schemas of the eleven domain tables and their enum domains.

Types follow the DDL of the reference: NUMERIC(10,2) -> decimal(10,2), TIMESTAMPTZ ->
timestamp_ntz (all instants are kept in one zone, UTC in tests), SERIAL -> int, BIGSERIAL -> long.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


L, I, S, D, TS = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.TimestampNTZType()

SCHEMAS: dict[str, T.StructType] = {
    "nationcode": _s(("country_code", S, False), ("country_name", S, False), ("default_nationality", S, False)),
    "room": _s(("rid", I, False), ("room_name", S, False)),
    "customers": _s(
        ("cid", L, False), ("nric_fin_passport_no", S, False), ("name", S, False), ("gender", S, False),
        ("mobile_number", S, False), ("country_code", S, False),
    ),
    "employees": _s(
        ("eid", L, False), ("nric_fin_passport_no", S, False), ("name", S, False), ("work_name", S, False),
        ("gender", S, False), ("mobile_number", S, False), ("country_code", S, False),
        ("employment_start", D, False), ("employment_end", D, True), ("created_at", TS, False), ("updated_at", TS, False),
    ),
    "role_definition": _s(("rdid", I, False), ("role_type", S, False)),
    "roles": _s(("rid", L, False), ("eid", L, False), ("rdid", I, False), ("start_date", D, False), ("end_date", D, True)),
    "services": _s(
        ("sid", L, False), ("name", S, False), ("description", S, False), ("duration_minutes", I, False),
        ("base_cost", MONEY, False), ("active_from", D, False), ("active_until", D, True), ("rdid", I, False),
    ),
    "transactions": _s(
        ("tid", L, False), ("cid", L, False), ("cashier_eid", L, False), ("billlevel_discount", MONEY, False),
        ("billlevel_discount_type", S, False), ("total_cost", MONEY, True), ("total_discount", MONEY, True),
        ("total_paid", MONEY, True), ("entry_time", TS, True), ("exit_time", TS, True), ("status", S, False),
        ("created_at", TS, False), ("updated_at", TS, False),
    ),
    "transaction_items": _s(
        ("ttid", L, False), ("tid", L, False), ("sid", L, False), ("therapist_eid", L, False),
        ("scheduled_start", TS, True), ("scheduled_end", TS, True), ("actual_start", TS, True), ("actual_end", TS, True),
        ("cost", MONEY, False), ("item_discount", MONEY, False), ("item_discount_type", S, False), ("rid", I, False),
    ),
    "payments": _s(
        ("pid", L, False), ("tid", L, False), ("payment_method", S, False), ("payment_amount", MONEY, False),
        ("payment_time", TS, False),
    ),
    "refunds": _s(
        ("refid", L, False), ("tid", L, False), ("refund_method", S, False), ("refund_amount", MONEY, False),
        ("refund_reason", S, True), ("refund_time", TS, False),
    ),
}

TABLES = tuple(SCHEMAS)

# The enum domains of the reference DDL, in declaration order.
STATUS = ("pending", "partial", "paid", "refunded", "cancelled", "completed")
DISCOUNT_TYPE = ("none", "promo", "waiver", "management", "staff")
GENDER = ("Male", "Female")
PAYMENT_METHOD = ("Cash", "Credit Card", "NETS", "PayNow", "eWallet", "Voucher")

# Declared VARCHAR/CHAR lengths, (table, column) -> n.
MAX_LENGTH = {
    ("nationcode", "country_code"): 2,
    ("nationcode", "country_name"): 64,
    ("nationcode", "default_nationality"): 64,
    ("room", "room_name"): 30,
    ("customers", "nric_fin_passport_no"): 64,
    ("customers", "name"): 64,
    ("customers", "mobile_number"): 32,
    ("customers", "country_code"): 2,
    ("employees", "nric_fin_passport_no"): 64,
    ("employees", "name"): 128,
    ("employees", "work_name"): 128,
    ("employees", "mobile_number"): 32,
    ("employees", "country_code"): 2,
    ("role_definition", "role_type"): 64,
    ("services", "name"): 255,
}
