"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import time

from frostline.plans import QUERIES
from frostline.session import local_session

HEADLINE = [
    "risk_summary",
    "threshold_risk",
    "service_status",
    "cumulative_exposure",
    "exposure_risk",
    "asof_prediction",
    "situation_analysis",
    "nearest_centres",
    "reroute_best",
    "decision_records",
    "alert_summary",
    "normalize_telemetry",
    "room_alerts",
    "feature_vectors",
    "train_sequences",
    "score_sequences",
    "vector_topk",
    "text_topk",
    "explanation_text",
    "fleet_snapshot",
    "stream_decisions",
    "stream_exposure",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, app="frostline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale,
    }))


if __name__ == "__main__":
    main()
