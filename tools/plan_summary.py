"""Print a one-line physical-plan summary per registered query: shuffles, broadcasts, join
kinds, windows, and the number of columns each Parquet scan reads.

Usage: python tools/plan_summary.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summary(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "nested_loop": plan.count("BroadcastNestedLoopJoin"),
        "cartesian": plan.count("CartesianProduct"),
        "windows": plan.count("Window "),
        "scan_columns": [len(s.split(",")) for s in re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", plan)],
    }


def main(argv: list[str]) -> None:
    from pyspark.sql import SparkSession

    from npxkit.plans.catalog import QUERIES

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in argv[2:] or sorted(QUERIES):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        print(f"{name:28s} {summary(plan)}")


if __name__ == "__main__":
    main(sys.argv)
