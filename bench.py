"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    measured runs of each query (default 3); the median counts
Every query runs once unmeasured on the smallest folder to warm the JVM up; its
whole result is produced and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import espalier.plans.catalog_workload  # noqa: E402, F401  (registers its queries)
import espalier.plans.upkeep_workload  # noqa: E402, F401  (registers its queries)
from espalier.plans.workload import QUERIES  # noqa: E402
from espalier.session import build_session, share  # noqa: E402

HEADLINE = [
    "hierarchy_full",
    "hierarchy_full_sorted",
    "hierarchy_flagged",
    "hierarchy_children",
    "hierarchy_summary",
    "hierarchy_summary_plain",
    "distinct_by_region",
    "zero_preserving",
    "check_unique_composite",
    "check_fk",
    "check_numeric",
    "validate_report",
    "cascade_delete",
    "cascade_surviving",
    "surrogate_keys",
    "lookup_after_clustering",
    "publish_audit",
    "trigram_count",
    "fuzzy_search",
    "fuzzy_texts",
    "fuzzy_titles_indexed",
    "pattern_search",
    "trigram_index",
    "similarity_join",
    "similar_long_titles",
    "catalog_summary",
    "catalog_cascade",
    "append_pruned",
    "publish_observed",
    "validate_incremental",
    "summary_bitmap",
    "lookup_zorder",
    "index_after_changes",
    "sorted_collated",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = share(build_session("bench", cpus, partitions=int(cpus)))
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    names = sys.argv[1:] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times = {}
    for name in names:
        if os.path.isdir(warm):
            run(spark, name, warm)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
