"""Times the headline queries once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tarnfield.queries import QUERIES
from tarnfield.session import local_session

HEADLINE = [
    "season_numbers", "wilson_interval", "all_pairs_mcnemar", "holm", "newcombe_interval", "accuracy_cube", "tally_grouping_sets",
    "vector_topk", "bm25_topk", "filter_before_topk", "rrf_hybrid", "evidence_rank", "span_containment_join", "chunk_fixed_windows",
    "latest_successful", "resume_pending", "cost_estimate", "rate_limiter_slots", "trim_pinned", "sensitivity", "scorecard_rank",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["season_numbers"](spark, sf_dir).collect()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf_dir.rstrip("/").rpartition("sf")[2] or 0)}))


if __name__ == "__main__":
    main()
