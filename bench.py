"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "trend_segments", "moving_averages", "tiny_trends", "index_trend_report", "upsert_keyset", "incremental_append",
    "ledger_merge", "argmax_size", "join_left_theta", "todo_anti", "topn_periods", "statement_clean", "label_merge",
    "fragment_pick", "keyword_facts", "unit_in_force", "ratio_dupont", "threshold_marks", "ratio_build", "scale_group",
    "windows_random", "windows_consecutive", "encode_chars", "growth_regression", "stream_incremental",
    "stream_moving_avg",
]


def main() -> None:
    from tidemark import registry
    from tidemark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "tidemark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # JVM warm-up
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry.JOBS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir).replace("sf", "")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
