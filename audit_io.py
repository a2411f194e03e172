"""Input and shuffle audit: every catalog query once at $BENCH_SF_DIR, with
Spark's event log written to a new scratch folder, then per query the number
of jobs, input records read and shuffle bytes written (from the task-end
events). Shows which queries read their input more than once or move more
data than they need.

$AUDIT_NO_BROADCAST=1 switches automatic broadcasts off, so the joins plan
as they would when the tables are too large to broadcast.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from convolytics.plans.catalog import QUERIES  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    log_dir = tempfile.mkdtemp(prefix="run-evlog-", dir=os.environ.get("AUDIT_SCRATCH", "/tmp"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("convolytics-audit")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", log_dir)
        .config("spark.eventLog.compress", "false")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
    )
    if os.environ.get("AUDIT_NO_BROADCAST") == "1":
        builder = builder.config("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name, query in QUERIES.items():
        spark.catalog.clearCache()
        spark.sparkContext.setJobDescription(name)
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()

    query_of_stage: dict[int, str] = {}
    jobs: dict[str, int] = {}
    records: dict[str, int] = {}
    shuffled: dict[str, int] = {}
    for path in glob.glob(f"{log_dir}/**/events_*", recursive=True):
        with open(path) as f:
            for line in f:
                event = json.loads(line)
                kind = event.get("Event")
                if kind == "SparkListenerJobStart":
                    name = (event.get("Properties") or {}).get("spark.job.description", "?")
                    jobs[name] = jobs.get(name, 0) + 1
                    for stage in event.get("Stage IDs", []):
                        query_of_stage[stage] = name
                elif kind == "SparkListenerTaskEnd":
                    metrics = event.get("Task Metrics") or {}
                    name = query_of_stage.get(event.get("Stage ID"), "?")
                    records[name] = records.get(name, 0) + (metrics.get("Input Metrics") or {}).get("Records Read", 0)
                    shuffled[name] = shuffled.get(name, 0) + (metrics.get("Shuffle Write Metrics") or {}).get(
                        "Shuffle Bytes Written", 0
                    )
    print(
        json.dumps(
            {
                "sf_dir": sf_dir,
                "event_log": log_dir,
                "queries": {
                    name: {"jobs": jobs.get(name, 0), "input_records": records.get(name, 0), "shuffle_bytes": shuffled.get(name, 0)}
                    for name in QUERIES
                },
            }
        )
    )


if __name__ == "__main__":
    main()
