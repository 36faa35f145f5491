"""python -m quarry --input transactions.txt --output folder -k 10 [--strategy projected] [--ties exact]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quarry.api import STRATEGIES, topk_hui
from quarry.sources.spmf import lines_of, read_spmf, write_result


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarry", description="Top-k high-utility itemsets")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", default="output")
    p.add_argument("-k", "--topk", type=int, default=10)
    p.add_argument("-s", "--strategy", choices=sorted(STRATEGIES), default="projected")
    p.add_argument("--ties", choices=("exact", "all"), default="exact")
    p.add_argument("--mode", choices=("permissive", "failfast"), default="permissive")
    p.add_argument("-e", "--eucs-prune", action=argparse.BooleanOptionalAction, default=True, help="pairs below the threshold are not grown (levelwise, projected)")
    p.add_argument("-r", "--raise-by", nargs="+", choices=("riu", "pe", "cud", "nu", "md", "leaf"), help="what raises the threshold before the search")
    p.add_argument("-w", "--workers", type=int, help="threads of a local run; a cluster has its own")
    a = p.parse_args(args)
    builder = SparkSession.builder.appName("quarry")
    spark = (builder.master(f"local[{a.workers}]") if a.workers else builder).getOrCreate()
    options = {} if a.strategy == "two_phase" else {"pair_filter": a.eucs_prune}
    try:
        found = topk_hui(lines_of(read_spmf(spark, a.input, a.mode)), a.topk, a.strategy, a.ties, a.raise_by and tuple(a.raise_by), **options)
        write_result(found.rows, a.output)
    except Exception as e:  # the command's exit code says so
        print(f"quarry: {e}", file=sys.stderr)
        return 1
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    print(found.stats | {"driver_heap_mb": (runtime.totalMemory() - runtime.freeMemory()) >> 20})
    return 0


if __name__ == "__main__":
    sys.exit(main())
