"""Helpers shared by the operators: scratch tables, row numbers, text bytes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LOCAL_DIRS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Only
    where it is unset and the session runs in one local process (tests) is a
    new folder under the system's temporary one used."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="run-llm-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it
    back: cuts the lineage, so a lost executor re-reads files instead of
    recomputing, and values that depend on task numbers stay fixed. The table
    is left in place, because the returned DataFrame is lazy; whoever owns
    the shared folder clears it after the job."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes a table made by ``staged`` that no lazy result reads any more."""
    spark = df.sparkSession
    root = scratch_dir(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(conf)
        if path.getParent() == system.makeQualified(jvm.org.apache.hadoop.fs.Path(root)):
            system.delete(path, True)


def workers_see_library(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package when the
    driver found it through ``sys.path`` only. On a cluster the package is
    installed or shipped with ``--py-files``."""
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if spark.sparkContext.master.startswith("local") and root not in known:
        env["PYTHONPATH"] = ":".join([root, *known])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_see_library(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(id_col: Column, n: int) -> Column:
    """``crc32(id as text) mod n``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "utf-8")) % n


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = 1000) -> DataFrame:
    """``rows`` joined with ``groups`` (one row per ``key``, with the number
    ``size`` of its rows). Keys that hold more than one in ``most`` of all rows
    are fewer than ``most``, so these alone are broadcast, and no row of them is
    shuffled; the rest meet in a shuffle in which no key is hot. ``groups``
    should be stored, since it is read several times."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * F.lit(most) > F.lit(total)
    heavy = groups.filter(hot)
    found = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(groups.filter(~hot), key)
    return found.unionByName(rest)


def text_source(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """The columns ``keep`` of ``docs`` and behind them the text, and what
    takes the texts out of a batch of these rows. A text that is a field of a
    kept column (``row.text``) travels in that column only, not twice."""
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in keep]
    outer, _, field = text_col.partition(".")
    if field and outer in keep and text_col not in docs.columns:
        place = keep.index(outer)
        at = [f.name.lower() for f in docs.schema[outer].dataType.fields].index(field.lower())
        return docs.select(*kept), lambda batch: pc.struct_field(batch.column(place), [at])
    place = len(keep)
    return docs.select(*kept, F.col(text_col).alias("_text")), lambda batch: batch.column(place)


def in_parts(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into small ones. Spark's memory for rows that come back
    from Python grows with the batch."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving back at the end of a task the memory that it no longer
    uses. The worker process stays, and what Arrow and the C library hold in
    reserve there would count while other operators run."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return task


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns and n.partition(".")[0] not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def whole_groups(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows with an equal first column, from
    batches sorted by it. A group of over ``most`` rows is handed out in
    parts, if given."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        key = table.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if most is not None and len(key) - cut > most:
            cut = len(key)
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut) if cut < len(key) else None
    if rest is not None:
        yield rest.combine_chunks()
