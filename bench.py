"""Seconds per headline query; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from sondeo.plans import catalog

HEADLINE = [
    "profile_numeric", "profile_table", "schema_summary", "outliers_iqr", "duplicate_count", "top_values",
    "distinct_counts", "data_profile", "clean_table", "impute_median", "impute_mode", "cap_iqr",
    "corr_pairs", "corr_target", "group_means", "histogram", "box_summary", "findings",
    "label_encode", "transform_features", "standard_scale", "mutual_info", "select_features", "fold_assign",
    "roc_auc_one_vs_rest", "class_metrics", "region_tag", "weather_enrichment", "geometry_flatten",
    "json_map_pivot", "disaster_summary", "latest_per_key", "last_k_per_key", "rolling_7d", "lag_features",
    "forward_fill", "version_numbers", "retention", "training_table_build", "analysis_gates",
    "train_forest", "train_cv", "train_ridge",
]
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
# Queries that take longer than this many seconds are timed once.
LONG = 5.0


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(query, spark: SparkSession, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    queries, _ = catalog.load_all()
    seconds = {}
    for name in HEADLINE:
        run(queries[name], spark, folder)
        times = [run(queries[name], spark, folder)]
        while len(times) < REPEATS and times[0] < LONG:
            times.append(run(queries[name], spark, folder))
        seconds[name] = round(statistics.median(times), 3)
    total = round(sum(seconds.values()), 3)
    line = {"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
