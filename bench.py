"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the given tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default: all);
BENCH_QUERIES: comma list of query names, or ``all``.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from hirelake.registry.queries import QUERIES
from hirelake.session import tuned

HEADLINE = [
    "salary_hist", "clean", "dashboard_counts", "summary", "keyword_counts", "filter_keyword", "import_join",
    "import_stats", "dedupe_business", "dedupe_greedy", "merge_complete", "merge_std", "consolidate_manifest", "jd_global",
    "provenance", "dup_profile", "dup_field_drift", "yield_keyword", "batch_yield", "coverage_counts", "coverage_scores",
    "jd_extract", "jd_term_df", "tokens", "flatten_response", "archive_read", "upsert_override", "stream_ledger",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("hirelake-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tuned(spark)
    QUERIES["salary_hist"](spark, sf_dir).collect()  # start the executors and load the classes
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "hirelake_headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cores,
    }))


if __name__ == "__main__":
    main()
