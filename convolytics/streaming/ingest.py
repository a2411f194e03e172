"""Incremental form of the load -> featurise -> export flow.

The dashboard recomputes everything whenever a file arrives. On a stream of
session files landing in a folder, Structured Streaming does the same work
incrementally: each new file is read with the same name-checked CSV reader
(S1, S4, long-row guard), featurised (P1) and appended to a Parquet table
(K4), and the running KPIs (A1-A6) are kept as a streaming aggregate.
Exactly-once bookkeeping lives in the checkpoint folder that the caller names
for each sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from convolytics.functions.numeric import rate
from convolytics.operators.features import add_text_features
from convolytics.schema import Columns, DEFAULT_COLUMNS, DEFAULT_LABELS, Labels, validate_names
from convolytics.sources.csv import csv_reader_options, csv_schema, guard_long_rows, normalize_null_tokens


def session_stream(
    spark: SparkSession, source_dir: str, names: Sequence[str], cols: Columns = DEFAULT_COLUMNS, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Streaming table of featurised sessions from CSV files arriving in
    ``source_dir``. ``names`` is the expected header (every file's header is
    checked against it)."""
    validate_names(list(names), cols)
    reader = spark.readStream.schema(csv_schema(names)).options(**csv_reader_options())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.csv(source_dir)
    return add_text_features(normalize_null_tokens(guard_long_rows(raw, names), names), cols)


def export_stream(
    featured: DataFrame, sink_dir: str, checkpoint_location: str, available_now: bool = True
) -> StreamingQuery:
    """K4 as a stream: append featurised rows to a Parquet table. Every sink
    needs a checkpoint folder of its own on shared storage: it records what
    this sink has received."""
    writer = (
        featured.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint_location)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(sink_dir)


def running_kpis(featured: DataFrame, cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """A1-A6 over everything seen so far (a global streaming aggregate, to be
    written in ``complete`` mode). Distinct counts use HyperLogLog++ sketches:
    exact distinct counts would keep every key in the state store."""
    return featured.agg(
        F.count(F.lit(1)).alias("total_conversations"),
        F.approx_count_distinct(cols.topic).alias("approx_unique_topics"),
        F.approx_count_distinct(cols.session_id).alias("approx_unique_sessions"),
        rate(F.col(cols.status) == labels.resolved).alias("resolution_rate_pct"),
        rate(F.col(cols.sentiment) == labels.negative).alias("negative_sentiment_pct"),
        rate(F.col(cols.status) == labels.drop_off).alias("drop_off_rate_pct"),
    )
