"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

The metric is scoring every customer from history (labels of three past windows and their mean); the other queries show the
engine's other shapes. Each is run once to warm up and then RUNS times; its figure is the median.
"""

from __future__ import annotations

import json
import os
import statistics
import time

import pyspark

from tideline.plans import catalogue
from tideline.session import local_session

RUNS = 5
HEADLINE = "hist_mean"
NAMES = [
    "hist_mean", "hist_probability", "churn_truth", "spend_avg_min_max", "order_count", "array_priority", "last_status", "where_mixed", "where_not_exists",
    "horizons_step", "hurdle", "rank_topk_hist", "multi_entity_anchor", "ctx_children_topk", "col_stats", "events_hours",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "8g"})
    found = catalogue.queries()
    out = {}
    for name in NAMES:
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        out[name] = round(statistics.median(took[1:]), 3)
    entities = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    print(json.dumps({
        "metric": "score every customer from history", "value": out[HEADLINE], "unit": "sec", "queries": out, "sf": sf_dir.rstrip("/").split("sf")[-1],
        "entities_per_sec": round(entities / out[HEADLINE]), "runs": RUNS, "cpus": cpus, "spark": pyspark.__version__, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))


if __name__ == "__main__":
    main()
