"""Times the headline queries: warm median of BENCH_RUNS runs each, results sent to the noop sink. One JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from geolattice import queries as q  # noqa: E402
from geolattice.functions.geohash import geohash  # noqa: E402
from geolattice.operators import keys, points  # noqa: E402
from geolattice.sources import generate, keyed  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def headline(spark: SparkSession) -> dict:
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select(F.col("l_orderkey").alias("k"))
    many = lines.select(F.expr(q.LON).alias("lon"), F.expr(q.LAT).alias("lat"))
    return {
        "within_full_scan": lambda: points.within(q.stored_points(spark, SF_DIR).drop("rowkey"), q.SQUARE),
        "within_prefix_plan": lambda: points.within(q.stored_points(spark, SF_DIR), q.SQUARE, rowkey_col="rowkey"),
        "knn_exact": lambda: points.knn_exact(q.stored_points(spark, SF_DIR), *q.AT, 10),
        "knn_by_cells": lambda: points.knn_by_cells(q.stored_points(spark, SF_DIR), *q.AT, 10),
        "earliest_2": lambda: keys.earliest_x(events, "user_id", "ts", 2, key_col="event_id"),
        "earliest_100": lambda: keys.earliest_x(events, "user_id", "ts", 100, key_col="event_id"),
        "first_n_per_bin": lambda: q.first_n_per_bin(spark, SF_DIR),
        "dedupe_last": lambda: q.dedupe_last(spark, SF_DIR),
        "geohash_encode_600k": lambda: many.select(geohash("lat", "lon").alias("h")),
        "spatial_join": lambda: q.spatial_join(spark, SF_DIR),
    }


def bulk_write(spark: SparkSession) -> None:
    """100,000 made-up points, keyed and written in order of the key."""
    keyed.write_sorted(generate.bulk_points(spark, 100_000, (-75.99, -75.01, 44.01, 44.99), seed=1), keyed.working_path(spark, "bench"))


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    spark = builder.config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {name: lambda f=f: f().write.format("noop").mode("overwrite").save() for name, f in headline(spark).items()}
    jobs["bulk_write_100k"] = lambda: bulk_write(spark)
    took = {}
    for name, job in jobs.items():
        times = []
        for _ in range(RUNS + 1):  # the first is the warm-up
            began = time.perf_counter()
            job()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": CPUS, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
