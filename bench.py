"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from cinderlog.catalog import QUERIES
from cinderlog.sources.scratch import stored_events

HEADLINE = (
    "agg_raw_1m", "agg_raw_1h", "agg_group_service", "agg_group_level", "agg_filter_all", "agg_rollup_whole", "agg_rollup_partial",
    "rollup_1s", "rollup_1m", "rollup_bucket_drift", "search_default", "search_service_level", "search_attr", "search_q", "search_page2",
    "validate_reasons", "validate_accepted", "gap_fill_hour", "percentile_ring", "store_append", "store_counters",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["agg_raw_1h"](spark, sf_dir).count()  # the first query compiles and loads classes
    began = time.perf_counter()
    stored_events(spark, sf_dir)  # what the agg_rollup queries read is there before they are asked
    set_up = round(time.perf_counter() - began, 3)
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "store_set_up": set_up, "ingest_logs_per_sec": round(rows / took["store_append"])}))


if __name__ == "__main__":
    main()
