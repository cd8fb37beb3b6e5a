"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and cores."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from skein.plans.queries import SQL, Q

REPEATS = 2


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in SQL:
        runs = []
        for _ in range(REPEATS):
            began = time.time()
            Q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(median(runs) if REPEATS > 2 else min(runs), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
