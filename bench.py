"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS choose data and cores; BENCH_QUERIES is a comma list or ``all``."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "w02_training_rows", "w03_first_wins_dedupe", "a01_policy_waterfall", "a02_feedback_filter",
    "c02_build_feeding_bundle", "c03_continual_export", "c04_build_web_chunks", "c06_search",
    "c07_validate_series", "c09_select_signature", "c12_contamination_report", "j03_translation_cache",
    "a05_document_frequency", "w04_rate_quota", "w05_failure_streak", "w06_circuit_intervals",
    "w08_slot_state", "t03_ratio_quota",
]


def main() -> None:
    from corpusflow.catalog import QUERIES
    from corpusflow.session import LOAD_PARTITIONS, local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = local_session(cpus, app="corpusflow-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(LOAD_PARTITIONS, cpus)  # the tables are single row groups
    spark.read.parquet(f"{sf}/documents.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        if asked:
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
