"""Invoices kept current over three change batches (D2, D4-D6), and deletions that cascade."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parlour.functions.temporal import ts_lit
from parlour.operators import changes as ch
from parlour.operators import maintained as mt
from parlour.operators import rollup as ru
from parlour.plans.queries_staff import STATUS_CASE
from parlour.plans import queries_management, queries_people  # noqa: F401  (their oracles serve here too)
from parlour.plans.registry import register, register_as
from parlour.plans.tables import AS_OF, tables
from parlour.session import checkpoint_dir


def change_batches(t) -> list[tuple]:
    """(signed amounts, exits) of three batches over the given tables."""
    def change(df, columns, old=True, new=None):
        row = F.struct(*columns)
        return df.select((row if old else F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType)).alias("old"),
                         (F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType) if new is None else F.struct(*new)).alias("new"))

    items, pays, tx = t["transaction_items"], t["payments"], t["transactions"]
    item, pay, refund = ["tid", "cost", "item_discount"], ["tid", "payment_amount"], ["tid", "refund_amount"]
    deleted = mt.item_amounts(change(items.where("ttid % 89 = 1"), item))
    updated = mt.item_amounts(change(items.where("ttid % 97 = 5 AND ttid % 89 <> 1"), item, new=["tid", (F.col("cost") + 20).alias("cost"), "item_discount"]))
    more = tx.where("tid % 19 = 2").select("tid", F.lit(80).cast("decimal(10,2)").alias("cost"), F.lit(5).cast("decimal(10,2)").alias("item_discount"))
    added = mt.item_amounts(change(more, item, old=False, new=item))
    paid = mt.payment_amounts(change(tx.where("tid % 11 = 4").select("tid", F.lit(50).cast("decimal(10,2)").alias("payment_amount")), pay, old=False, new=pay))
    raised = mt.payment_amounts(change(pays.where("pid % 23 = 0"), pay, new=["tid", (F.col("payment_amount") + 30).alias("payment_amount")]))
    void = mt.payment_amounts(change(pays.where("pid % 46 = 2"), pay))
    back = mt.refund_amounts(change(tx.where("tid % 17 = 3").select("tid", F.lit(25).cast("decimal(10,2)").alias("refund_amount")), refund, old=False, new=refund))
    exits = tx.where("tid % 13 = 6").select("tid", ts_lit(AS_OF).alias("exit_time"))
    return [(deleted.unionByName(paid), None), (updated.unionByName(back), exits), (added.unionByName(raised).unionByName(void), None)]


def maintained_invoices(spark, sf_dir):
    t = tables(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/invoices-{uuid.uuid4().hex}"
    mt.start(t["transactions"], path)
    for k, (amounts, exits) in enumerate(change_batches(t), 1):
        mt.apply_batch(spark, path, k, amounts, exits)
    return mt.current(spark, path)


# the items, payments and refunds as they are after each batch, summed anew; a state is that of the step before unless touched
_ITEMS = ("SELECT tid, cost, item_discount FROM transaction_items WHERE ttid % 89 <> 1",
          "SELECT tid, CASE WHEN ttid % 97 = 5 THEN cost + 20 ELSE cost END AS cost, item_discount FROM transaction_items WHERE ttid % 89 <> 1")
_ITEMS = (*_ITEMS, _ITEMS[1] + " UNION ALL SELECT tid, 80, 5 FROM transactions WHERE tid % 19 = 2")
_PAID = "SELECT tid, payment_amount AS a FROM payments UNION ALL SELECT tid, -refund_amount FROM refunds UNION ALL SELECT tid, 50 FROM transactions WHERE tid % 11 = 4"
_BACK = " UNION ALL SELECT tid, -25 FROM transactions WHERE tid % 17 = 3"
_PAIDS = (_PAID, _PAID + _BACK, _PAID.replace("payment_amount AS a FROM payments", "CASE WHEN pid % 23 = 0 THEN payment_amount + 30 ELSE payment_amount END AS a FROM payments WHERE pid % 46 <> 2") + _BACK)
_EVENTS = ("SELECT tid FROM transactions WHERE tid % 11 = 4", "SELECT tid FROM transactions WHERE tid % 17 = 3 OR tid % 13 = 6",
           "SELECT tid FROM payments WHERE pid % 23 = 0 OR pid % 46 = 2")
_TOUCHES = ("SELECT tid FROM transaction_items WHERE ttid % 89 = 1", "SELECT tid FROM transaction_items WHERE ttid % 97 = 5 AND ttid % 89 <> 1",
            "SELECT tid FROM transactions WHERE tid % 19 = 2")


def _step(k: int) -> str:
    before = "(SELECT tid, billlevel_discount, exit_time, status FROM transactions)" if k == 0 else f"s{k - 1}"
    left = f"CASE WHEN tid % 13 = 6 THEN COALESCE(exit_time, TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}') ELSE exit_time END" if k == 1 else "exit_time"
    return f"""s{k} AS (SELECT tid, billlevel_discount, total_cost, total_discount, total_paid, exit_time,
  CASE WHEN tid IN ({_EVENTS[k]}) AND total_cost - total_discount - total_paid <= 0 AND exit_time IS NOT NULL THEN 'completed'
       WHEN tid IN ({_EVENTS[k]} UNION ALL {_TOUCHES[k]}) THEN {STATUS_CASE} ELSE status END AS status
  FROM (SELECT b.tid, billlevel_discount, {left} AS exit_time, status, COALESCE(c, 0) AS total_cost, COALESCE(d, 0) + COALESCE(billlevel_discount, 0) AS total_discount,
               COALESCE(p, 0) AS total_paid
        FROM {before} b LEFT JOIN (SELECT tid, sum(cost) AS c, sum(item_discount) AS d FROM ({_ITEMS[k]}) GROUP BY tid) USING (tid)
        LEFT JOIN (SELECT tid, sum(a) AS p FROM ({_PAIDS[k]}) GROUP BY tid) USING (tid)))"""


register("maintained_invoices", f"""WITH {", ".join(map(_step, range(3)))}
SELECT tid, CAST(total_cost AS DOUBLE) AS total_cost, CAST(total_discount AS DOUBLE) AS total_discount, CAST(total_paid AS DOUBLE) AS total_paid, exit_time, status
FROM s2""")(maintained_invoices)


# ---- U6: deletions that cascade ----------------------------------------------------------
def _asked(t, table, key, rest):
    """Keys of ``table`` by modulus, some asked for twice, and one that does not exist for each seventh."""
    k = t[table].select(F.col(key).cast("long").alias("key")).where(rest)
    return k.unionByName(k.where("key % 2 = 0")).unionByName(k.where("key % 7 = 0").select((F.col("key") + 50000000).alias("key")))


def _asked_sql(table: str, key: str, rest: str) -> str:
    return f"asked AS (SELECT {key} AS key FROM {table} WHERE {rest.replace('key', key)} UNION SELECT {key} + 50000000 FROM {table} WHERE ({rest.replace('key', key)}) AND {key} % 7 = 0)"


def _met_sql(table: str, key: str, children: list[tuple[str, str, str]]) -> str:
    """The references met by each asked key, counted child by child."""
    met = " UNION ALL ".join(f"SELECT {col} AS key, '{child}' AS child, '{col}' AS fk_column, '{action}' AS action, count(*) AS n_rows FROM {child} WHERE {col} IN (FROM asked) GROUP BY {col}"
                             for child, col, action in children)
    return f"""met AS ({met}),
no AS (SELECT key, CASE WHEN key NOT IN (SELECT {key} FROM {table}) THEN '{ch.MSG_NOT_FOUND}' WHEN key IN (SELECT key FROM met WHERE action = 'restrict') THEN '{ch.MSG_REFERENCED}' END AS reason FROM asked)
SELECT key, child, fk_column, action, COALESCE(n_rows, 0) AS n_rows, reason IS NULL AS accepted, reason FROM no LEFT JOIN met USING (key)"""


register("cascade_delete_transactions", f"""WITH {_asked_sql('transactions', 'tid', 'key % 29 = 4')},
{_met_sql('transactions', 'tid', [('transaction_items', 'tid', 'cascade'), ('payments', 'tid', 'cascade'), ('refunds', 'tid', 'cascade')])}""")(
    lambda s, d: (lambda t: ch.cascade_delete(t, "transactions", _asked(t, "transactions", "tid", "key % 29 = 4")))(tables(s, d)))
register("cascade_delete_employees", f"""WITH {_asked_sql('employees', 'eid', 'key % 3 = 1')},
{_met_sql('employees', 'eid', [('roles', 'eid', 'cascade'), ('transactions', 'cashier_eid', 'restrict'), ('transaction_items', 'therapist_eid', 'restrict')])}""")(
    lambda s, d: (lambda t: ch.cascade_delete(t, "employees", _asked(t, "employees", "eid", "key % 3 = 1")))(tables(s, d)))


# ---- M2-M4 and T2 from the daily summary -------------------------------------------------
def _summary(spark, t):
    path = f"{checkpoint_dir(spark)}/daily-{uuid.uuid4().hex}"
    ru.refresh(t, path)
    return path


for _name in ("service_counts", "revenue", "payment_breakdown", "therapist_period_stats"):
    register_as(f"{_name}_from_days", _name)(
        (lambda name: lambda s, d: (lambda t: getattr(ru, name)(s, t, _summary(s, t), AS_OF))(tables(s, d)))(_name))
