"""Session helpers for scripts and tests. Library operators never create a
session or set configuration; they take the caller's."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "convolytics", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks: UI off, AQE on, ANSI as
    default. Shuffle partitions default to twice the cores (AQE coalesces
    small ones)."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    parts = shuffle_partitions or max(2, 2 * int(n or 1))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CONVOLYTICS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster sets it to
    shared storage). Only when it is unset and the caller passes ``default``
    (tests, local runs) is ``default`` used and set. Never falls back to a
    machine-local folder on its own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if default is None:
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    spark.conf.set("spark.checkpoint.dir", default)
    spark.sparkContext.setCheckpointDir(default)
    return spark.sparkContext.getCheckpointDir() or default


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. A local session that names none gets
    one of its own under the system's temporary folder, once."""
    local = spark.sparkContext.master.startswith("local")
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = checkpoint_dir(spark, tempfile.mkdtemp(prefix="convolytics-") if local and not named else None)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, so that
    several readers do not compute it again; unchanged where the session names
    no folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def workers_see_library(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package when the
    driver found it through ``sys.path`` only. On a cluster the package is
    installed or shipped with ``--py-files``."""
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if spark.sparkContext.master.startswith("local") and root not in known:
        env["PYTHONPATH"] = ":".join([root, *known])
