"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is run to completion with the ``noop`` sink (every row computed, nothing
collected to the driver). One warm-up pass, then the median of $BENCH_REPS runs per query.
Set BENCH_ALL=1 to time every registered query instead of the headline set.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "high_spenders", "service_counts", "payment_breakdown", "avg_spend_per_visit", "room_utilization",
    "leaderboard_gaps", "top_customers", "therapist_period_stats", "active_transactions", "busy_now",
    "top_therapists_per_customer", "last_therapist", "invoice_item_rows", "customer_conflicts",
    "candidate_therapists", "service_clock", "payment_intake_status", "audit_foreign_keys", "entry_exit_log_month",
    "edit_candidate_therapists", "audit_checks", "audit_domains", "edit_items", "stream_net_paid", "transaction_detail",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    from parlour.session import get_session
    from parlour.plans import QUERIES

    spark = get_session(f"local[{cpus}]", app="parlour-bench", shuffle_partitions=int(cpus) * 2)
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else [n for n in HEADLINE if n in QUERIES]
    times: dict[str, float] = {}
    for n in names:
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[n] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
