"""Benchmark the headline queries.

Runs each query to completion with the ``noop`` sink (the full plan runs,
nothing is collected to the driver) on ``local[$BENCH_CPUS]`` over
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) and prints one JSON line:
{"metric": ..., "value": total_seconds, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f2_frame_funnel",            # frames -> D1 -> G1 -> funnel (flagship)
    "g1_prev_quality_hash",
    "d5_fallback",
    "h6_select_representative",
    "h1_select_compact",
    "f6_class_summary",
    "c18_risk_score",
    "f12_asset_risk",
    "g4_story_frames",
    "f17_class_heatmap",
    "l1_runs_mart",
    "l2_class_metrics_mart",
    "l3_dynamics_mart",
    "l4_stage_times_mart",
    "l10_panel_class_frames_video",
    "g9_latest_run",
    "k1_stage_times",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="keelson-bench-")
    from keelson.session import get_spark
    from keelson.plans.catalog import QUERIES

    spark = get_spark(f"local[{cpus}]", app="keelson-bench", shuffle_partitions=int(cpus),
                      extra={"spark.driver.memory": "16g", "spark.checkpoint.dir": f"{scratch}/ckpt",
                             "spark.local.dir": f"{scratch}/local"})
    names = [q for q in (os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE)
             if q in QUERIES]
    # warm the JVM (class loading, JIT, codegen caches) on the tiny smoke data,
    # not on the benchmark data, so the first timed query is not charged for it
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for q in ("f2_frame_funnel", "l1_runs_mart"):
            QUERIES[q](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
