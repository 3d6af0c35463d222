"""Times the headline queries and prints one JSON line.

Reads the tables in $BENCH_SF_DIR on local[$BENCH_CPUS]. Each query runs once to warm up
and then three times to the end (every row is produced, none is kept); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from dataloupe.catalog import QUERIES  # noqa: E402

HEADLINES = (
    "read_table_csv", "clean_rows", "duplicate_row_count", "drop_duplicates", "null_cell_count",
    "apply_recipes", "add_days_between", "time_span", "profile_lineitem", "profile_part",
    "categorical_profile_long_texts", "outliers_by_group", "outliers_global", "clip_outliers",
    "iqr_outliers", "dispersion", "concentration", "normalized_entropy", "forensic_summary_numeric",
    "category_pareto", "category_pareto_many_categories", "top_k_others_hard_cap", "choose_chart",
    "histogram_by_hue", "kde", "box_stats_by_hue", "violin", "line_mean_by_hue", "rolling_mean_rows",
    "rolling_mean_by_group", "composition_over_time", "heatmap", "facet_lines", "events_per_hour",
    "run_chart_query_sum", "chart_battery", "triage_findings",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    workers = int(cpus) if cpus.isdigit() else 8
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(workers))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: round(measured(spark, folder, name), 4) for name in HEADLINES}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


def measured(spark: SparkSession, folder: str, name: str) -> float:
    taken = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return statistics.median(taken[1:])


if __name__ == "__main__":
    main()
