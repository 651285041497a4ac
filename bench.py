"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from demo import load_all
from demo.adapter import network
from demo.registry import QUERIES

HEADLINE = ["stations_nearby", "search_stations", "stations_by_id", "stations_by_group", "line_stations",
            "lines_by_group", "routes", "route_types", "arrival_times", "train_route", "bus_stops_near",
            "enrich_group_stations", "station_train_types", "stop_route_order", "integrated_pattern_rows"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("netloom-bench")
             .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    times = {}
    start = time.time()
    network(spark, sf_dir)
    times["build_network"] = round(time.time() - start, 3)
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        # Materialises every row and column without collecting them.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "network queries, whole tables", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip('/')).removeprefix("sf")}))


if __name__ == "__main__":
    main()
