"""A damaged overlay for the audits: the fixture tables are clean, so copies of a few rows of every table are
added, each with one fault, so that every rule of Q1-Q5 is broken somewhere (copies also repeat their keys).
The same faults in Spark and in DuckDB SQL, as expressions that both read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlour.sources.schemas import SCHEMAS

# Which rows get damaged copies.
PICKED = {
    "nationcode": "country_code = '03'", "room": "rid = 3", "customers": "cid % 97 = 3", "employees": "eid % 97 = 3",
    "role_definition": "rdid = 3", "roles": "rid % 97 = 2", "services": "sid % 97 = 3", "transactions": "tid % 997 = 3",
    "transaction_items": "ttid % 997 = 2", "payments": "pid % 998 = 2", "refunds": "refid % 970 = 30",
}
EARLY_DAY, EARLY = "DATE '1900-01-01'", "TIMESTAMP '1900-01-01 00:00:00'"
# The faults: column and value. Every column also gets a copy in which it is NULL.
FAULTS = {
    "nationcode": [("country_code", "'XXX'"), ("country_name", "repeat('x', 65)"), ("default_nationality", "repeat('x', 65)")],
    "room": [("room_name", "repeat('x', 31)")],
    "customers": [("mobile_number", "'+65 12'"), ("gender", "'Other'"), ("country_code", "'?'"), ("country_code", "'XXX'"), ("nric_fin_passport_no", "repeat('x', 65)"),
                  ("name", "repeat('x', 65)"), ("mobile_number", "repeat('1', 33)")],
    "employees": [("mobile_number", "'+65 12'"), ("gender", "'Other'"), ("country_code", "'?'"), ("country_code", "'XXX'"), ("nric_fin_passport_no", "repeat('x', 65)"),
                  ("name", "repeat('x', 65)"), ("name", "repeat('x', 129)"), ("work_name", "repeat('x', 129)"), ("mobile_number", "repeat('1', 33)"),
                  ("employment_end", EARLY_DAY)],
    "role_definition": [("role_type", "repeat('x', 65)")],
    "roles": [("end_date", EARLY_DAY), ("eid", "987654321"), ("rdid", "987654321")],
    "services": [("duration_minutes", "-1"), ("base_cost", "-1"), ("active_until", EARLY_DAY), ("rdid", "987654321"), ("name", "repeat('x', 256)")],
    "transactions": [("billlevel_discount", "-1"), ("total_cost", "-1"), ("total_discount", "-1"), ("total_paid", "-1"), ("billlevel_discount", "total_cost + 1"),
                     ("exit_time", EARLY), ("cid", "987654321"), ("cashier_eid", "987654321"), ("billlevel_discount_type", "'gift'"), ("status", "'lost'")],
    "transaction_items": [("cost", "0"), ("item_discount", "-1"), ("item_discount", "cost + 1"), ("scheduled_end", EARLY), ("actual_end", EARLY),
                          ("tid", "987654321"), ("sid", "987654321"), ("therapist_eid", "987654321"), ("rid", "987654321"), ("item_discount_type", "'gift'")],
    "payments": [("payment_amount", "-1"), ("payment_method", "'Bitcoin'"), ("tid", "987654321")],
    "refunds": [("refund_amount", "0"), ("refund_method", "'Bitcoin'"), ("tid", "987654321")],
}


def _variants(name: str) -> list[tuple[str, str]]:
    return FAULTS[name] + [(f.name, "NULL") for f in SCHEMAS[name].fields]


def dirty(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out = {}
    for name, df in t.items():
        variants = _variants(name)
        copies = F.when(F.expr(PICKED[name]), F.sequence(F.lit(0), F.lit(len(variants)))).otherwise(F.array(F.lit(0)))
        damaged = df.withColumn("_v", F.explode(copies))
        cols = []
        for f in SCHEMAS[name].fields:
            c = F.col(f.name)
            for k, (col, value) in enumerate(variants, 1):
                if col == f.name:
                    c = F.when(F.col("_v") == k, F.expr(value).cast(f.dataType)).otherwise(c)
            cols.append(c.alias(f.name))
        out[name] = damaged.select(cols)
    return out


def dirty_ctes() -> str:
    out = []
    for name, schema in SCHEMAS.items():
        variants = _variants(name)
        cols = []
        for f in schema.fields:
            cases = " ".join(f"WHEN _v = {k} THEN {value}" for k, (col, value) in enumerate(variants, 1) if col == f.name)
            cols.append(f"CASE {cases} ELSE {f.name} END AS {f.name}" if cases else f.name)
        out.append(f"d_{name} AS (SELECT {', '.join(cols)} FROM {name} JOIN range(0, {len(variants) + 1}) v(_v) ON _v = 0 OR {PICKED[name]})")
    return ", ".join(out)
