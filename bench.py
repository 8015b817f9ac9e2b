"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query runs once to warm up and is then timed on a full materialisation.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paylattice.plans import catalog  # noqa: E402
from paylattice.session import get_session  # noqa: E402

HEADLINE = [
    "salary_by_city", "salary_by_seniority", "remote_vs_onsite", "market_summary", "top_skills", "company_profiles",
    "company_top_roles", "company_recent", "search_page", "salary_normalize", "salary_from_text", "skills_extract",
    "footer_metadata", "dedup_keep_salary", "clean_jobs", "bulk_load_map", "insert_if_absent", "union_master",
    "source_health", "training_readiness", "salary_percentile_rank", "target_encode", "features_fit", "final_prediction",
    "similar_jobs", "offer_analysis", "page_anchor_jobs", "page_salary_scan", "incremental_merge", "stream_health",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            catalog.JOBS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
