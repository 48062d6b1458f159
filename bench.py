"""Time the headline queries; prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set it up."""

from __future__ import annotations

import json
import os
import statistics
import time

from maskwright.catalog import load
from maskwright.session import local_session

HEADLINE = ("entry_gated_taxonomy_micro", "e1_overlap_pairs", "m7_mask_union", "a1_pixel_metrics", "a6_taxonomy_block", "a18_policy_sweep",
            "p10_candidate_history", "g2_mask_metrics", "d12_rebuild", "w1_stable_ids", "r20_audit_fold")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, "bench")
    registry, times = load(), {}
    registry["d3_split_manifest"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    for name in HEADLINE:
        took = []
        for _ in range(runs):
            start = time.time()
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        times[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "runs": runs, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
