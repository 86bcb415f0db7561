"""Streaming (D9) and JSON encoding (S2) queries."""

from __future__ import annotations

from parlour.operators import customer as cu
from parlour.plans.registry import register
from parlour.plans.tables import tables
from parlour.sources.sinks import json_rows
from parlour.streaming.net_paid import stream_net_paid

register("stream_net_paid", """
SELECT t.tid, CAST(COALESCE((SELECT SUM(payment_amount) FROM payments p WHERE p.tid = t.tid), 0)
                 - COALESCE((SELECT SUM(refund_amount) FROM refunds r WHERE r.tid = t.tid), 0) AS DOUBLE) AS total_paid
FROM transactions t""")(lambda s, d: stream_net_paid(s, tables(s, d)))

register("invoices_json", """
SELECT tid, to_json({'cid': cid, 'tid': tid, 'entry_time': strftime(entry_time, '%Y-%m-%dT%H:%M:%S'),
  'total_cost': CAST(total_cost AS DOUBLE), 'total_discount': CAST(total_discount AS DOUBLE),
  'net': CAST(total_cost - total_discount AS DOUBLE), 'total_paid': CAST(total_paid AS DOUBLE),
  'status': status})::VARCHAR AS json
FROM transactions""")(lambda s, d: json_rows(cu.invoices(tables(s, d)), key="tid"))
