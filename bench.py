"""Benchmark: every catalog query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced to full evaluation with the ``noop`` sink; one warm-up
pass, then $BENCH_RUNS timed passes, median per query, each from an empty
cache. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from convolytics.plans.catalog import QUERIES  # noqa: E402
from convolytics.session import local_session  # noqa: E402


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _timed(spark, name: str, sf_dir: str) -> float:
    # Some operators persist a small intermediate (histogram value counts,
    # duplicate candidates). Spark would reuse it for the identical plan of
    # the next run, so every run starts from an empty cache.
    spark.catalog.clearCache()
    t0 = time.perf_counter()
    _run(QUERIES[name](spark, sf_dir))
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, app="convolytics-bench")

    names = only or list(QUERIES)
    for name in names:  # warm-up: JIT, file listing, codegen caches
        _timed(spark, name, sf_dir)

    times: dict[str, float] = {}
    for name in names:
        samples = [_timed(spark, name, sf_dir) for _ in range(runs)]
        times[name] = round(statistics.median(samples), 4)

    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum_of_median_query_seconds",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "cpus": cpus,
                "runs": runs,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
