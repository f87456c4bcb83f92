"""Times the headline queries: one warm-up, then the median of three runs; one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tickloom.plans.queries import QUERIES

HEADLINE = ["bars_30m", "daily_ohlcv", "attach_features", "grid_filled", "lookback_pct", "ewm", "describe_col", "corr_pairs", "gapfill_1m", "interval_join_index", "roc_auc"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(found.values()), 4), "unit": "sec", "queries": found, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
