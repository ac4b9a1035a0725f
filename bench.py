"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed completely into Spark's ``noop`` sink (no rows are
collected to the driver).  Prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stepwise.operators import bpe  # noqa: E402
from stepwise.plans import bindings as bd  # noqa: E402
from stepwise.plans.catalog import QUERIES  # noqa: E402
from stepwise.session import local_session  # noqa: E402

HEADLINE = [
    "best_steps",            # S1-J1-W2-P7-A5-J2 flagship
    "best_steps_skew_safe",  # same, no run-keyed windows (hot runs split)
    "log_summary",           # W1 count windows
    "log_summary_accuracy",  # W1 + A6 over logits batches
    "facet_train_frac",      # A1
    "word_freq",             # A13 over the whole corpus
    "pair_counts",           # A15
    "encode_conversations",  # T3/T4
    "round_trip_documents",  # T4 + T6 over the whole corpus
    "random_split",          # X1 / K1
    "epoch_shuffle",         # W6 / K1
    "range_events",          # P9 / K1 range order
    "grid_expand",           # G1
    "score_centroids",       # M2
    "evaluate_splits",       # M4
    "layer_norm",            # F10
    "stream_log_summary",    # R1 streaming
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    mem = os.environ.get("BENCH_DRIVER_MEMORY", "16g")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, driver_memory=mem, app="stepwise-bench")
    times: dict[str, float] = {}

    t0 = time.time()
    docs = bd.table(spark, sf_dir, "documents")
    model = bpe.bpe_train(docs, "text", "doc_id", new_tokens=200)
    times["bpe_train_200"] = round(time.time() - t0, 3)

    for name in HEADLINE:
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    t0 = time.time()
    bpe.encode(docs, "text", "doc_id", model).write.format("noop").mode("overwrite").save()
    times["encode_documents_200"] = round(time.time() - t0, 3)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
