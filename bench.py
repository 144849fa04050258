"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed completely with the ``noop`` sink (no collect to
the driver) after one warm-up run of a tiny query.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dashboard_kpis", "daily_kpis", "resolve_customers", "customer_order_history", "order_totals",
    "order_documents", "stock_ledger", "status_transitions", "apply_status_changes", "cancel_orders",
    "search_catalog", "resolve_products", "speech_segments", "latest_call_state", "echo_gate", "barge_in",
    "clean_text", "is_repetitive", "extract_tool_call", "upsert_catalog", "allocate_orders",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    os.environ.setdefault("KIRANA_MASTER", f"local[{cpus}]")
    os.environ.setdefault("KIRANA_SHUFFLE_PARTITIONS", str(max(cpus, 8)))
    from kirana.plans.catalog import all_queries
    from kirana.session import get_spark

    spark = get_spark(master=f"local[{cpus}]")
    qs = all_queries()
    # warm-up: JVM, codegen caches and the parquet footers
    qs["load_tables"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for key in (only or HEADLINE):
        t0 = time.perf_counter()
        qs[key].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
