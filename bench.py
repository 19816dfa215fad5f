"""Benchmark: all analysis queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query: one warm-up run, then $BENCH_RUNS timed runs (default 3; one if
the warm-up took over 3 s); the median is reported.  A run executes the whole plan into Spark's ``noop``
sink (no collection to the driver).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from adlytics.session import get_spark
    from adlytics.plans.registry import all_queries
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus))
    qs = all_queries()
    names = only or list(qs)
    out: dict[str, float] = {}
    for name in names:
        q = qs[name]
        times = []
        for i in range(runs + 1):
            if i > 1 and warm > 3:
                break
            t0 = time.perf_counter()
            q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i == 0:
                warm = dt
            else:
                times.append(dt)
        out[name] = round(statistics.median(times), 3)
        print(f"# {name}: {out[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": sf, "cpus": cpus, "runs": runs,
                      "spark": {"shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                                "aqe": spark.conf.get("spark.sql.adaptive.enabled")}}))


if __name__ == "__main__":
    main()
