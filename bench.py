"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice into a sink that keeps nothing and the second run counts; one whose first run takes more than
20 seconds is not repeated.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyspark.plans import catalog  # noqa: E402
from tallyspark.session import local_session  # noqa: E402

HEADLINE = [
    "a3_weak_labels", "p14_fix_chain", "d2_dedupe_masked", "d3_dedupe_folded", "d5_dedupe_mode", "j2_append_new_masked",
    "j4_merge_feedback", "a9_averages", "a11_eval_hierarchical", "a12_latency", "k5_subsample", "f5_extract_amounts",
    "f22_parse_time_range", "j16_rows_in_phrase", "a25_profile", "m8_rule_baseline", "w1_group_lines", "w4_label_boxes",
    "w15_total_amount", "j11_match_items",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tallyspark-bench")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        first = run(spark, name, folder)
        times[name] = round(first if first > 20 else run(spark, name, folder), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(folder).name.replace("sf", "")}))


if __name__ == "__main__":
    main()
