"""Bench: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query runs end to end from the parquet tables (the shared corpus / parse /
graph cache is cleared before every query) and is fully executed with the
``noop`` sink, so the time covers the whole plan and nothing is collected.
One untimed query warms the session up first.  Set BENCH_QUERIES=key1,key2 to run a subset
(BENCH_QUERIES=all: every registered key).
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphloom.plans import pipeline as P  # noqa: E402
from graphloom.plans.queries import REGISTRY  # noqa: E402
from graphloom.session import get_spark  # noqa: E402

HEADLINE = [
    "parsed_files", "build_graph", "calls_edges_settled", "call_graph", "call_reach", "find_by_endpoint",
    "search_code", "search_any", "search_phrase", "search_fuzzy", "question_context", "write_result",
    "apply_writes", "upsert_graph", "stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = os.environ.get("BENCH_QUERIES")
    keys = (sorted(REGISTRY) if keys == "all" else keys.split(",")) if keys else HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times: dict[str, float] = {}
    REGISTRY["analyze_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    REGISTRY["class_names"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for key in keys:
        P.clear()
        t0 = time.perf_counter()
        REGISTRY[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
        print(f"# {key}: {times[key]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
