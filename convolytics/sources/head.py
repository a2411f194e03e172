"""The first rows of a table as its files hold them.

Files are taken in the order of their names and read from the start, each by
one task that stops after the rows still wanted; no row is sorted by its
content, and files after the last row needed are not opened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from convolytics.schema import Columns, DEFAULT_COLUMNS
from convolytics.sources.csv import detect_format, read_csv, read_csv_header

_AT = "_row_in_file"


def _parquet_head(spark: SparkSession, file: str, table: DataFrame, n: int) -> DataFrame:
    part = spark.read.schema(table.schema).parquet(file)
    # row numbers are those of the file, whatever order its splits come in
    placed = part.select("*", F.col("_metadata.row_index").alias(_AT)).filter(F.col(_AT) < n)
    return placed.coalesce(1).limit(n).orderBy(_AT).drop(_AT)


def first_rows(spark: SparkSession, path: str | Sequence[str], n: int = 10, fmt: str | None = None, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """The first ``n`` rows (a bounded preview) without the ``suggestion``
    column, in file order. ``fmt`` is ``parquet`` or ``csv``, by default from
    the suffix. At most ``n`` rows reach the driver."""
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt or detect_format(paths[0].rstrip("/"))
    if fmt == "parquet":
        table = spark.read.parquet(*paths)
    elif fmt == "csv":
        names = read_csv_header(spark, paths)
        table = read_csv(spark, paths, names)
    else:
        raise ValueError(f"no first rows of {fmt!r} files")
    rows: list = []
    for file in sorted(table.inputFiles()):
        if len(rows) == n:
            break
        left = n - len(rows)
        head = _parquet_head(spark, file, table, left) if fmt == "parquet" else read_csv(spark, file, names).limit(left)
        rows += head.collect()
    return spark.createDataFrame(rows, table.schema).drop(cols.suggestion)
