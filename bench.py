"""Times the headline queries and prints one JSON line.

Every query runs once to warm up the JVM's code paths, then the faster of two
runs counts; the result is written out in full.
"""

from __future__ import annotations

import json
import os
import sys
import time

from workload import registry
from workload.compare import session

HEADLINE = ("ensemble_aggregate", "agg_borda", "yeojohnson_lambda", "corr_pearson", "reverse_lasso")
MORE = ("fold_scores", "stratified_folds", "power_windows", "elect_bucklin", "store_results")


def timed(run, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    seconds: dict[str, float] = {}
    for key in HEADLINE + MORE:
        timed(queries[key], spark, sf_dir)
        seconds[key] = round(min(timed(queries[key], spark, sf_dir) for _ in range(2)), 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    total = round(sum(seconds[k] for k in HEADLINE), 3)
    print(
        json.dumps(
            {
                "metric": "sum of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
