"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores. Every query runs once to warm
up, then the timed run writes its whole result to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestar.plans import all_queries  # noqa: E402
from lodestar.session import build_session  # noqa: E402

HEADLINE = [
    "F3_closing_soon",
    "F4_filter_sector_domain",
    "A1_period_counters",
    "A7_activity_breakdown",
    "A13_category_facet",
    "A15_review_stats",
    "A25_orphan_references",
    "E5_verdicts",
    "E7_ranked_buckets",
    "E8_extract_eligibility",
    "J8_entity_resolution",
    "M2_text_exists",
    "M7j_change_ledger",
    "M9_rollback_plan",
    "Q7_search",
    "Q8_typeahead",
    "W1_section_carry_forward",
    "X4_normalize_text",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench", f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        extra={"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries().queries
    times = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
