"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores. Every query runs
once to warm up and then ``BENCH_RUNS`` times (default 2); the best time counts.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revloom.catalog import all_queries  # noqa: E402

HEADLINE = ("A3_file_churn", "A6_contributor_stats", "A23_J2_W4_recent_hotspots", "K9_file_coupling",
            "A5_commit_frequency_month", "K1_file_lifetimes", "A1_core_files", "C2_file_heat",
            "M1_persistence_metrics", "W3_pareto", "J9_commit_as_of", "S2_P11_name_status_scan")


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.log.level", "ERROR")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate())
    registry = all_queries()
    times = {}
    for key in wanted:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            registry[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            if attempt:
                best = taken if best is None else min(best, taken)
        times[key] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
