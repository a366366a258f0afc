"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated query names instead of the headline set
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cleargrain.session import configure  # noqa: E402
from suite.queries import QUERIES  # noqa: E402

HEADLINE = [
    "p3_normalize_documents",
    "a1_column_profile",
    "a5_missing_values_report",
    "d1_exact_duplicates",
    "d2_identifier_duplicates",
    "d4_probable_duplicates",
    "d6_duplicate_groups",
    "v1_value_counts",
    "v3_exact_matches",
    "v8_scored_pairs",
    "v11_variant_report",
    "v11_variant_report_trade",
    "c4_cleaned_table",
    "l3_key_figures",
    "l4_owner_chart",
    "l8_compare_to_whole",
    "l11_search",
    "g12_final_facts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
    )
    spark = configure(builder, shuffle_partitions=cpus).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Start the workers and load the classes once, outside the timings.
    QUERIES["v10_strongest_matches"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
