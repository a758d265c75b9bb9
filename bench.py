"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from timberline.plans.registry import QUERIES  # noqa: E402

HEADLINE = (
    "level_counts", "parse_entries", "search_combined", "count_matches", "search_context",
    "last_entries", "compute_stats", "group_by_message", "group_by_source", "hourly_windows",
    "read_files", "redact_documents", "redact_entries", "template_frequency", "mine_templates",
    "first_match", "compress_all", "compress_by_file",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="timberline-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("timberline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    # one small query first, so that starting up is not charged to the first measurement
    QUERIES["format_counts"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        begun = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    lines = spark.read.parquet(f"{folder}/events.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "log analytics, total of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "log_lines": lines,
            }
        )
    )


if __name__ == "__main__":
    main()
