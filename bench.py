"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (3).
Every query runs once to warm up and then BENCH_RUNS times; the median counts. Results go to a
sink that reads every row and keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from tidewatch.plans import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

# query -> table whose rows it processes
HEADLINE = {
    "company_features": "events",
    "company_features_plain": "events",
    "shock_features": "events",
    "running_features": "events",
    "alert_cooldown": "events",
    "kv_upsert_features": "events",
    "shock_prefilter": "documents",
    "detect_companies": "documents",
    "detect_companies_by_dim": "documents",
    "enrich_news": "documents",
    "score_lexicon": "documents",
    "score_tiered": "documents",
    "st_features": "events",
    "st_shocks": "documents",
}


def main() -> None:
    catalog.load()
    with tempfile.TemporaryDirectory(prefix="bench-") as shared:
        run(shared)


def run(shared: str) -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", str(CPUS))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", shared)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    rows = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in set(HEADLINE.values())}
    seconds = {}
    for name in HEADLINE:
        query = catalog.runner(name)
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds,
        "rows_per_sec": {q: round(rows[t] / seconds[q]) for q, t in HEADLINE.items()},
        "cpus": CPUS, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
