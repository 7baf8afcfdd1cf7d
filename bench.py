"""Headline timings on one machine: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from sievestone.catalog.model_checks import CLASSES, baskets  # noqa: E402
from sievestone.catalog.tables import sales  # noqa: E402
from sievestone.operators import detect, inject, labels, models, profile  # noqa: E402
from sievestone.operators.prepare import prepare  # noqa: E402
from sievestone.operators.spelling import analyse_spelling, spelling_rate  # noqa: E402
from sievestone.plans.audit import audit, repair  # noqa: E402
from sievestone.session import build_session, cut_lineage  # noqa: E402
from sievestone.sources.readers import read_parquet, with_row_id  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def sink(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = build_session(CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    items = with_row_id(spark.read.parquet(f"{FOLDER}/lineitem.parquet"))
    orders = cut_lineage(sales(spark, FOLDER))
    orders.count()
    table = cut_lineage(baskets(spark, FOLDER).drop("net"))
    state = {}

    def cheap_audit():
        state["audit"] = audit(items, "row_id")

    def apply_both():
        result = repair(state["audit"])
        sink(result.cleaned)
        sink(result.log)

    queries = {
        "load_lineitem": lambda: sink(read_parquet(spark, f"{FOLDER}/lineitem.parquet")),
        "type_and_mask": lambda: sink(prepare(items, "row_id").frame),
        "missing_rate": lambda: sink(detect.missing_rates(items, items.columns)),
        "duplicate_rate": lambda: sink(detect.duplicate_rate(items, items.columns[1:])),
        "outlier_rate": lambda: sink(detect.outlier_rates(items, detect.fences(items, NUMBERS)[0])),
        "spelling_rate": lambda: sink(spelling_rate(orders, "row_id", analyse_spelling(orders, ["status", "priority", "segment"]))),
        "number_stats": lambda: sink(profile.number_stats(items, NUMBERS)),
        "health_snapshot": lambda: sink(profile.build_snapshot(items, "row_id")),
        "cheap_audit": cheap_audit,
        "apply_and_log": apply_both,
        "inject_missing": lambda: sink(inject.inject_missing(orders, "row_id", orders.columns[1:], 0.1, 7).frame),
        "inject_swaps": lambda: sink(inject.inject_swaps(orders, "row_id", ["segment", "balance"], 0.1, 7).frame),
        "random_forest_fit_score": lambda: models.evaluate(CLASSES, "random_forest", table.filter(F.col("row_id") % 10 < 7), table.filter(F.col("row_id") % 10 >= 7), 0, 20),
        "label_errors": lambda: sink(labels.noisy_labels(labels.label_scores(table, "row_id", "size", CLASSES.numbers, CLASSES.texts, 3, 20))),
    }
    timings = {}
    for name, run in queries.items():
        start = time.time()
        run()
        timings[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": os.path.basename(FOLDER.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
