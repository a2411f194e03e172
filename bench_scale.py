"""Scaling benchmark: the session table of $BENCH_SF_DIR repeated
$BENCH_SCALE times (session ids made distinct per copy), written once as
Parquet under $BENCH_SCRATCH (default: a new folder from ``mktemp -d`` in
/tmp for local runs; point it at shared storage on a cluster), then every
dashboard analysis over it, forced with the ``noop`` sink.

$BENCH_MATERIALIZE (``none`` by default) selects how the featurised table
is held before the analyses run: ``none`` re-derives the features in every
analysis; ``table`` or ``checkpoint`` materialise them once under
``spark.checkpoint.dir`` (set to the scratch folder when unset), as
``plans.dashboard`` does.

Prints one JSON line: rows, seconds per analysis, total and rows/s.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from convolytics.plans.dashboard import analyses, materialize  # noqa: E402
from convolytics.session import checkpoint_dir, local_session  # noqa: E402
from convolytics.sources import fixtures  # noqa: E402
from convolytics.operators.features import add_text_features  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    scale = int(os.environ.get("BENCH_SCALE", "100"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = local_session(cpus, app="convolytics-bench-scale")

    path = f"{scratch.rstrip('/')}/sessions_x{scale}.parquet"
    base = fixtures.sessions(spark, sf_dir)
    copies = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(scale))).alias("_copy"))
    scaled = copies.withColumn(
        "SESSION_ID", F.when(F.col("SESSION_ID").isNotNull(), F.concat_ws("-", "SESSION_ID", F.col("_copy").cast("string")))
    ).drop("_copy")
    t0 = time.perf_counter()
    # many files, so the scan has one split per task slot or more
    scaled.repartition(max(4 * int(cpus), scale // 10)).write.mode("errorifexists").parquet(path)
    write_s = time.perf_counter() - t0

    how = os.environ.get("BENCH_MATERIALIZE", "none")
    featured = add_text_features(spark.read.parquet(path))
    t0 = time.perf_counter()
    if how != "none":
        checkpoint_dir(spark, default=f"{scratch.rstrip('/')}/checkpoints")
        featured = materialize(featured, how)
    materialize_s = time.perf_counter() - t0
    rows = featured.count()
    times = {}
    for name, fn in analyses().items():
        t0 = time.perf_counter()
        fn(featured).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = sum(times.values())
    print(json.dumps({
        "metric": "dashboard_seconds_on_scaled_sessions",
        "value": round(total, 3),
        "unit": "sec",
        "rows": rows,
        "scale": scale,
        "rows_per_sec_per_analysis": round(rows * len(times) / total),
        "write_seconds": round(write_s, 3),
        "materialize": how,
        "materialize_seconds": round(materialize_s, 3),
        "queries": times,
        "path": path,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
