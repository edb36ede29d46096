"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from flightframe.catalog import QUERIES, load_all
from flightframe.session import local_session

HEADLINE = (
    "landing_status", "truth_associated", "mutual_nearest", "threshold_sweep", "rank_auc", "continuity", "motion_baseline",
    "trajectory", "gps_phase", "calibration_samples", "translation_estimated", "group_statistics", "scene_quality", "motion_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.conf.set("spark.sql.dataFrameQueryContext.enabled", "false")
    load_all()
    QUERIES["motion_summary"](spark, sf_dir).collect()  # starts the engine
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
