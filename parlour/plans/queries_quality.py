"""Audits Q1-Q5 over the damaged overlay. The oracles state the constraints of the DDL once more, as fixed
values of their own, so that a wrong or missing rule of the operators shows."""

from __future__ import annotations

from parlour.operators import quality as q
from parlour.plans.dirty import dirty, dirty_ctes
from parlour.plans.registry import register
from parlour.plans.tables import tables

# Table, key, rule, condition under which a row breaks it.
BROKEN = """customers|cid|mobile_digits|NOT regexp_full_match(mobile_number, '[0-9]+')
employees|eid|employment_end_after_start|employment_end < employment_start
roles|rid|end_after_start|end_date < start_date
services|sid|duration_non_negative|duration_minutes < 0
services|sid|base_cost_non_negative|base_cost < 0
services|sid|active_until_after_from|active_until < active_from
transactions|tid|billlevel_discount_non_negative|billlevel_discount < 0
transactions|tid|total_cost_non_negative|total_cost < 0
transactions|tid|total_discount_non_negative|total_discount < 0
transactions|tid|total_paid_non_negative|total_paid < 0
transactions|tid|billlevel_discount_within_cost|billlevel_discount > total_cost
transactions|tid|exit_after_entry|exit_time <= entry_time
transaction_items|ttid|cost_positive|cost <= 0
transaction_items|ttid|item_discount_within_cost|item_discount < 0 OR item_discount > cost
transaction_items|ttid|scheduled_end_after_start|scheduled_end < scheduled_start
transaction_items|ttid|actual_end_after_start|actual_end < actual_start
payments|pid|amount_non_negative|payment_amount < 0
refunds|refid|amount_positive|refund_amount <= 0"""

KEYS = """nationcode.country_code room.rid room.room_name customers.cid customers.nric_fin_passport_no employees.eid
employees.nric_fin_passport_no role_definition.rdid role_definition.role_type roles.rid services.sid transactions.tid
transaction_items.ttid payments.pid refunds.refid"""

REFERENCES = """customers.country_code>nationcode employees.country_code>nationcode roles.eid>employees roles.rdid>role_definition
services.rdid>role_definition transactions.cid>customers transactions.cashier_eid>employees.eid transaction_items.tid>transactions
transaction_items.sid>services transaction_items.therapist_eid>employees.eid transaction_items.rid>room payments.tid>transactions
refunds.tid>transactions"""

_DISCOUNTS = "'none', 'promo', 'waiver', 'management', 'staff'"
_METHODS = "'Cash', 'Credit Card', 'NETS', 'PayNow', 'eWallet', 'Voucher'"
ENUMS = {
    "customers.gender": "'Male', 'Female'", "employees.gender": "'Male', 'Female'", "transactions.billlevel_discount_type": _DISCOUNTS,
    "transactions.status": "'pending', 'partial', 'paid', 'refunded', 'cancelled', 'completed'",
    "transaction_items.item_discount_type": _DISCOUNTS, "payments.payment_method": _METHODS, "refunds.refund_method": _METHODS,
}

LENGTHS = """nationcode.country_code 2 nationcode.country_name 64 nationcode.default_nationality 64 room.room_name 30
customers.nric_fin_passport_no 64 customers.name 64 customers.mobile_number 32 customers.country_code 2 employees.nric_fin_passport_no 64
employees.name 128 employees.work_name 128 employees.mobile_number 32 employees.country_code 2 role_definition.role_type 64 services.name 255"""

REQUIRED = """nationcode country_code country_name default_nationality; room rid room_name;
customers cid nric_fin_passport_no name gender mobile_number country_code;
employees eid nric_fin_passport_no name work_name gender mobile_number country_code employment_start created_at updated_at;
role_definition rdid role_type; roles rid eid rdid start_date;
services sid name description duration_minutes base_cost active_from rdid;
transactions tid cid cashier_eid billlevel_discount billlevel_discount_type status created_at updated_at;
transaction_items ttid tid sid therapist_eid cost item_discount item_discount_type rid;
payments pid tid payment_method payment_amount payment_time; refunds refid tid refund_method refund_amount refund_time"""


def _over_dirty(parts: list[str]) -> str:
    return f"WITH {dirty_ctes()} " + " UNION ALL ".join(parts)


def _checks_sql() -> str:
    rows = [line.split("|", 3) for line in BROKEN.splitlines()]
    return _over_dirty([f"SELECT '{t}' AS table_name, '{rule}' AS rule, CAST({key} AS VARCHAR) AS key FROM d_{t} WHERE {broken}" for t, key, rule, broken in rows])


def _unique_sql() -> str:
    return _over_dirty([f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT({c}) AS n_rows "
                        f"FROM d_{t} GROUP BY {c} HAVING COUNT({c}) > 1" for t, c in (k.split(".") for k in KEYS.split())])


def _fk_sql() -> str:
    parts = []
    for ref in REFERENCES.split():
        (t, c), parent = ref.split(">")[0].split("."), ref.split(">")[1]
        p, pc = parent.split(".") if "." in parent else (parent, c)
        parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{p}' AS parent_table, CAST(x.{c} AS VARCHAR) AS value, COUNT(*) AS n_rows "
                     f"FROM d_{t} x LEFT JOIN (SELECT DISTINCT {pc} AS k FROM d_{p}) y ON y.k = x.{c} WHERE x.{c} IS NOT NULL AND y.k IS NULL GROUP BY x.{c}")
    return _over_dirty(parts)


def _domain_sql() -> str:
    parts = [f"SELECT '{tc.split('.')[0]}' AS table_name, '{tc.split('.')[1]}' AS column_name, 'enum' AS rule, {tc.split('.')[1]} AS value, COUNT(*) AS n_rows "
             f"FROM d_{tc.split('.')[0]} WHERE {tc.split('.')[1]} NOT IN ({dom}) GROUP BY {tc.split('.')[1]}" for tc, dom in ENUMS.items()]
    words = LENGTHS.split()
    for tc, n in zip(words[::2], words[1::2]):
        t, c = tc.split(".")
        parts.append(f"SELECT '{t}', '{c}', 'length>{n}', {c}, COUNT(*) FROM d_{t} WHERE length({c}) > {n} GROUP BY {c}")
    return _over_dirty(parts)


def _not_null_sql() -> str:
    parts = []
    for group in REQUIRED.split(";"):
        t, *cols = group.split()
        parts += [f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM d_{t}" for c in cols]
    return _over_dirty(parts)


register("audit_checks", _checks_sql())(lambda s, d: q.audit_checks(dirty(tables(s, d))))
register("audit_unique", _unique_sql())(lambda s, d: q.audit_unique(dirty(tables(s, d))))
register("audit_foreign_keys", _fk_sql())(lambda s, d: q.audit_foreign_keys(dirty(tables(s, d))))
register("audit_domains", _domain_sql())(lambda s, d: q.audit_domains(dirty(tables(s, d))))
register("audit_not_null", _not_null_sql())(lambda s, d: q.audit_not_null(dirty(tables(s, d))))
