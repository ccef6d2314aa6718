"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "user_summary", "category_stats", "daily_trend", "system_stats", "user_category_stats",  # scan and aggregate
    "page_per_user", "pending_queue_page",  # top k
    "expense_detail", "expense_dossier",  # joins, nested children
    "keyword_category", "suggest_category",  # rules
    "extract_receipt", "blocks_to_kv",  # text
    "validate_expenses", "integrity_report", "backfill_audit",
    "actions_expenses",  # the whole workflow batch
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    from checks import load_all
    from checks.registry import QUERIES

    load_all()
    spark.read.parquet(f"{folder}/orders.parquet").count()  # JVM warm-up
    spent = {}
    for name in HEADLINE:
        for _ in range(2):  # the first run builds the query's inputs and compiles, and does not count
            started = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
