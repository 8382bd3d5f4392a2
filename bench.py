"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (the whole plan executes, nothing
is collected to the driver). One untimed pass over all queries first pays JVM class loading
and JIT compilation; then every query is timed twice and the faster run is recorded (the
machine is shared; the minimum is the least noisy estimate). The warm-up total is
reported too. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "replicate_intra_cv_long",
    "duplicate_samples",
    "recode_low_quality",
    "cv_quartiles",
    "cv_quartiles_lod",
    "normalize_pc",
    "append_fixed_lod",
    "npx_boxplot",
    "sample_qc_matrix",
    "impute_median",
    "pca_scores",
    "cv_density",
    "median_cv_overall",
    "cv_by_block",
    "wide_matrix",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from pyspark.sql import SparkSession

    from npxkit.plans.catalog import QUERIES
    from npxkit.session import ensure_checkpoint_dir

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("npxkit-bench")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cpus) * 2)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    warmup = sum(run(name) for name in names)
    times = {name: round(min(run(name), run(name)), 3) for name in names}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "warmup_pass_sec": round(warmup, 3),
                "timing": "min of 2 runs after a warm-up pass",
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
