"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from latentlake.catalog import all_queries  # noqa: E402
from latentlake.runtime import local_session  # noqa: E402

HEADLINE = [
    "g1_latent_stats",
    "g1_latent_stats_table",
    "h4_top_tiles",
    "h4_top_tiles_encoded",
    "h7_diversify",
    "k1_all_rankings",
    "g3_slide_latent_stats",
    "g5_latent_metrics",
    "g9_cohort_enrichment",
    "g10_label_enrichment",
    "g12_histogram_bins",
    "g17_percentile_clamp",
    "d1_cap_tiles",
    "e5_pool2x2",
    "g13_prototypes",
    "g15_target_stats",
    "j1_registry_mapping",
    "j8_label_cascade",
    "j11_remap_paths",
    "j12_materialize",
    "p1_mine_top_tiles",
    "p2_representatives",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    # one untimed query starts the JVM code paths and the Python workers
    queries["g2_finalize_stats"](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
