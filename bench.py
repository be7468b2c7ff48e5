"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from benchset.queries import QUERIES  # noqa: E402
from tillflow.session import get_session  # noqa: E402

HEADLINE = [
    "weekly_category_revenue", "numeric_clean", "date_clean", "expiry_extract", "reject_summary", "dedup_first",
    "fill_down", "barcode_match", "fuzzy_match", "product_match", "product_merge", "fact_sales", "kpi",
    "traffic_tier", "clean_report", "load_report", "stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
    })
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    result = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if "clean_report" in seconds:
        result["clean_rows_per_sec"] = round(lines / seconds["clean_report"])
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
