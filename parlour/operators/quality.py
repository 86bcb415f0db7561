"""Q1-Q5: the reference's constraints (CHECK, PK/UNIQUE, FK, enum/length, NOT NULL) as audits.

Spark enforces none of them, so each becomes a query that lists the violating rows. Every
audit is a union of per-table scans, anti joins or aggregates; none collects rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlour.sources.schemas import DISCOUNT_TYPE, GENDER, MAX_LENGTH, PAYMENT_METHOD, SCHEMAS, STATUS

# CHECK constraints as (table, name, key column, predicate that must hold).
CHECKS = (
    ("customers", "mobile_digits", "cid", "regexp_like(mobile_number, '^[0-9]+$')"),
    ("employees", "employment_end_after_start", "eid", "employment_end >= employment_start"),
    ("roles", "end_after_start", "rid", "end_date >= start_date"),
    ("services", "duration_non_negative", "sid", "duration_minutes >= 0"),
    ("services", "base_cost_non_negative", "sid", "base_cost >= 0"),
    ("services", "active_until_after_from", "sid", "active_until >= active_from"),
    ("transactions", "billlevel_discount_non_negative", "tid", "billlevel_discount >= 0"),
    ("transactions", "total_cost_non_negative", "tid", "total_cost >= 0"),
    ("transactions", "total_discount_non_negative", "tid", "total_discount >= 0"),
    ("transactions", "total_paid_non_negative", "tid", "total_paid >= 0"),
    ("transactions", "billlevel_discount_within_cost", "tid", "billlevel_discount <= total_cost"),
    ("transactions", "exit_after_entry", "tid", "exit_time > entry_time"),
    ("transaction_items", "cost_positive", "ttid", "cost > 0"),
    ("transaction_items", "item_discount_within_cost", "ttid", "item_discount >= 0 AND item_discount <= cost"),
    ("transaction_items", "scheduled_end_after_start", "ttid", "scheduled_end >= scheduled_start"),
    ("transaction_items", "actual_end_after_start", "ttid", "actual_end >= actual_start"),
    ("payments", "amount_non_negative", "pid", "payment_amount >= 0"),
    ("refunds", "amount_positive", "refid", "refund_amount > 0"),
)

# Primary keys and UNIQUE columns.
UNIQUE = (
    ("nationcode", "country_code"), ("room", "rid"), ("room", "room_name"), ("customers", "cid"),
    ("customers", "nric_fin_passport_no"), ("employees", "eid"), ("employees", "nric_fin_passport_no"),
    ("role_definition", "rdid"), ("role_definition", "role_type"), ("roles", "rid"), ("services", "sid"),
    ("transactions", "tid"), ("transaction_items", "ttid"), ("payments", "pid"), ("refunds", "refid"),
)

# Foreign keys (child table, column, parent table, column).
FOREIGN_KEYS = (
    ("customers", "country_code", "nationcode", "country_code"),
    ("employees", "country_code", "nationcode", "country_code"),
    ("roles", "eid", "employees", "eid"),
    ("roles", "rdid", "role_definition", "rdid"),
    ("services", "rdid", "role_definition", "rdid"),
    ("transactions", "cid", "customers", "cid"),
    ("transactions", "cashier_eid", "employees", "eid"),
    ("transaction_items", "tid", "transactions", "tid"),
    ("transaction_items", "sid", "services", "sid"),
    ("transaction_items", "therapist_eid", "employees", "eid"),
    ("transaction_items", "rid", "room", "rid"),
    ("payments", "tid", "transactions", "tid"),
    ("refunds", "tid", "transactions", "tid"),
)

# Enum-typed columns and their domains.
DOMAINS = (
    ("customers", "gender", GENDER), ("employees", "gender", GENDER),
    ("transactions", "billlevel_discount_type", DISCOUNT_TYPE), ("transactions", "status", STATUS),
    ("transaction_items", "item_discount_type", DISCOUNT_TYPE), ("payments", "payment_method", PAYMENT_METHOD),
    ("refunds", "refund_method", PAYMENT_METHOD),
)

# Nullable columns; every other declared column is NOT NULL.
NULLABLE = {
    ("employees", "employment_end"), ("roles", "end_date"), ("services", "active_until"),
    ("transactions", "total_cost"), ("transactions", "total_discount"), ("transactions", "total_paid"),
    ("transactions", "entry_time"), ("transactions", "exit_time"), ("transaction_items", "scheduled_start"),
    ("transaction_items", "scheduled_end"), ("transaction_items", "actual_start"), ("transaction_items", "actual_end"),
    ("refunds", "refund_reason"),
}


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _by_table(rules) -> dict[str, list]:
    out: dict[str, list] = {}
    for rule in rules:
        out.setdefault(rule[0], []).append(rule)
    return out


def audit_checks(t: dict[str, DataFrame]) -> DataFrame:
    """Q1: one row per CHECK violation ``(table_name, rule, key)``, one scan per table. A NULL predicate passes."""
    out = []
    for tab, rules in _by_table(CHECKS).items():
        broken = F.array_compact(F.array(*[F.when(~F.expr(pred), F.lit(rule)) for _, rule, _, pred in rules]))
        out.append(t[tab].select(F.lit(tab).alias("table_name"), F.explode(broken).alias("rule"), F.col(rules[0][2]).cast("string").alias("key")))
    return _union(out)


def audit_unique(t: dict[str, DataFrame]) -> DataFrame:
    """Q2: values of a key or UNIQUE column held by more than one row, with the row count."""
    return _union([
        t[tab].where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
        .select(F.lit(tab).alias("table_name"), F.lit(col).alias("column_name"),
                F.col(col).cast("string").alias("value"), "n_rows")
        for tab, col in UNIQUE])


def audit_foreign_keys(t: dict[str, DataFrame]) -> DataFrame:
    """Q3: child rows whose (non-NULL) reference has no parent row. Each table is read once: its references and, if others
    refer to it, its own keys come out stacked as (parent, value, constraint). They are counted by key before the shuffle,
    so that a key many rows share is one row, and a value without a parent's row among its rows is reported."""
    stacked = []
    for name in dict.fromkeys([fk[0] for fk in FOREIGN_KEYS] + [fk[2] for fk in FOREIGN_KEYS]):
        refs = [(parent, col, i) for i, (child, col, parent, _) in enumerate(FOREIGN_KEYS) if child == name]
        own = dict.fromkeys((name, pcol, -1) for _, _, parent, pcol in FOREIGN_KEYS if parent == name)
        entries = [F.struct(F.lit(parent).alias("parent"), F.col(col).cast("string").alias("value"), F.lit(i).alias("fk")) for parent, col, i in [*refs, *own]]
        stacked.append(t[name].select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("value").isNotNull()))
    counted = _union(stacked).groupBy("parent", "value", "fk").agg(F.count(F.lit(1)).alias("n"))
    met = counted.groupBy("parent", "value").agg(F.collect_list(F.struct("fk", "n")).alias("refs"), F.min("fk").alias("least"))  # a row a constraint at most
    lost = met.where("least >= 0").select("parent", "value", F.explode("refs").alias("r"))
    named = lambda k: F.element_at(F.array(*[F.lit(fk[k]) for fk in FOREIGN_KEYS]), F.col("r.fk") + 1)
    return lost.select(named(0).alias("table_name"), named(1).alias("column_name"), F.col("parent").alias("parent_table"), "value", F.col("r.n").alias("n_rows"))


def audit_domains(t: dict[str, DataFrame]) -> DataFrame:
    """Q4: enum values outside their domain, and strings longer than their declared length; one scan per table."""
    rules = [(tab, col, "enum", ~F.col(col).isin(*dom)) for tab, col, dom in DOMAINS]
    rules += [(tab, col, f"length>{n}", F.length(col) > n) for (tab, col), n in MAX_LENGTH.items()]
    out = []
    for tab, own in _by_table(rules).items():
        bad = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(col).alias("column_name"), F.lit(rule).alias("rule"), F.col(col).alias("value")))
                                        for _, col, rule, broken in own]))
        out.append(t[tab].select(F.explode(bad).alias("b")).groupBy(F.lit(tab).alias("table_name"), "b.column_name", "b.rule", "b.value")
                   .agg(F.count(F.lit(1)).alias("n_rows")))
    return _union(out)


def not_null_columns() -> list[tuple[str, str]]:
    return [(tab, f.name) for tab, s in SCHEMAS.items() for f in s.fields if (tab, f.name) not in NULLABLE]


def audit_not_null(t: dict[str, DataFrame]) -> DataFrame:
    """Q5: NULL count of every NOT NULL column (zeros included): one aggregate pass per table,
    then the per-column counts are unpivoted into rows."""
    out = []
    by_table: dict[str, list[str]] = {}
    for tab, col in not_null_columns():
        by_table.setdefault(tab, []).append(col)
    for tab, cols in by_table.items():
        row = t[tab].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        out.append(row.unpivot([], cols, "column_name", "null_count").select(
            F.lit(tab).alias("table_name"), "column_name", "null_count"))
    return _union(out)
