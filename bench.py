"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], one JSON line.

``python bench.py all`` times every registered query instead, ``python bench.py name ...`` the named ones."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from vacantia.plans import load
from vacantia.session import local_session

HEADLINE = ["page_job_audit", "captured_jobs", "list_scores", "page_lines", "detail_links", "recognised_jd", "split_postings", "first_records",
            "import_metrics", "duplicate_audit", "dedup_trace", "merged_scopes", "data_completeness", "batch_audit", "throughput_eta",
            "peak_concurrency", "bound_cards", "merged_details", "export_cells", "csv_rows"]


def run(query, spark, folder) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(args) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    registry = load()
    chosen = list(registry) if args == ["all"] else (args or HEADLINE)
    rounds = 1 if args == ["all"] else 3
    times = {}
    run(registry["canonical_name"], spark, folder)
    for name in chosen:
        if rounds > 1:
            run(registry[name], spark, folder)
        times[name] = round(statistics.median(run(registry[name], spark, folder) for _ in range(rounds)), 3)
        if args == ["all"]:
            print(f"{times[name]:8.2f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": cores}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
