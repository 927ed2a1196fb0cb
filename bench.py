"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line of seconds."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sparrowmill import catalog

KEYS = ["cand_global", "cand_segment", "cand_unpack", "cand_recall", "feat_avg_jaccard", "feat_cosine", "knn_exact", "feat_customer_manual", "ga_sessions", "gr_khop", "ts_cross_validate"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = catalog.queries()
    plans["agg_count_rows"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds, rows = {}, {}
    for key in KEYS:
        # Every column is computed and thrown away; a count would let the optimizer drop them. Rows are counted apart.
        began = time.perf_counter()
        plans[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - began, 3)
    for key in KEYS:
        rows[key] = plans[key](spark, sf_dir).count()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "rows": rows, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
