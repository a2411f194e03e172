"""Report exports (K1-K5).

CSV options: header row, ``"`` quoting with doubled quotes inside, null and
empty text both written as an empty field, embedded newlines kept inside
quotes (so S1 reads the files back unchanged). Output directories are named
``<report>_<YYYYmmdd_HHMMSS>.csv`` and never overwritten.

Every report is written by Spark's writer, one file per partition. The
summary reports have one row per topic; ``single_file=True`` asks for one
part file (one writing task), which suits them when the topic count is small.
The full dataset is always written in parallel.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from convolytics import constants as K
from convolytics.operators.crosstab import CrosstabError, xt_topic_sentiment_margins, xt_topic_status_margins
from convolytics.operators.grouped import topic_summary_report
from convolytics.schema import Columns, DEFAULT_COLUMNS, DEFAULT_LABELS, Labels

CSV_WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "encoding": "UTF-8"}


def report_path(out_dir: str, report: str, run_ts: datetime | None = None) -> str:
    """K5: ``<out_dir>/<report>_<YYYYmmdd_HHMMSS>.csv``."""
    ts = (run_ts or datetime.now()).strftime(K.REPORT_TIMESTAMP_FORMAT)
    return f"{out_dir.rstrip('/')}/{report}_{ts}.csv"


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> str:
    seen: dict[str, str] = {}
    for name in df.columns:
        other = seen.setdefault(name.lower(), name)
        if other is not name:
            raise CrosstabError(f"Columns {other!r} and {name!r} differ only in case and cannot be told apart in a file")
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).options(**CSV_WRITE_OPTIONS).csv(path)
    return path


def csv_records(df: DataFrame) -> DataFrame:
    """K4 body: every row as one CSV record (column ``record``), with the
    options the files are written with."""
    options = {k: v for k, v in CSV_WRITE_OPTIONS.items() if k not in ("header", "encoding")}
    return df.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options).alias("record"))


def topic_summary_export(featured: DataFrame, cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """K1 body: the topic summary with the exported column headers."""
    rep = topic_summary_report(featured, cols, labels)
    value_cols = ["total_conversations", "resolution_rate_pct", "positive_sentiment_pct", "avg_query_words", "avg_response_words"]
    return rep.select(F.col(cols.topic), *[F.col(c).alias(h) for c, h in zip(value_cols, K.TOPIC_SUMMARY_HEADERS)])


def export_reports(
    featured: DataFrame,
    out_dir: str,
    run_ts: datetime | None = None,
    cols: Columns = DEFAULT_COLUMNS,
    full_format: str = "csv",
    single_file_summaries: bool = False,
    labels: Labels = DEFAULT_LABELS,
) -> dict[str, str]:
    """K1-K4: writes the topic summary, the topic x status and topic x
    sentiment cross-tabs with totals, and the full featurised table. Returns
    report name -> output path. ``featured`` should be materialised by the
    caller when all four are written (see ``plans.dashboard``)."""
    run_ts = run_ts or datetime.now()
    paths = {
        K.REPORT_TOPIC_SUMMARY: write_csv(
            topic_summary_export(featured, cols, labels), report_path(out_dir, K.REPORT_TOPIC_SUMMARY, run_ts), single_file_summaries
        ),
        K.REPORT_RESOLUTION: write_csv(
            xt_topic_status_margins(featured, cols), report_path(out_dir, K.REPORT_RESOLUTION, run_ts), single_file_summaries
        ),
        K.REPORT_SENTIMENT: write_csv(
            xt_topic_sentiment_margins(featured, cols), report_path(out_dir, K.REPORT_SENTIMENT, run_ts), single_file_summaries
        ),
    }
    full = report_path(out_dir, K.REPORT_FULL_DATASET, run_ts)
    if full_format == "parquet":
        full = full[: -len(".csv")] + ".parquet"
        featured.write.mode("errorifexists").parquet(full)
    else:
        write_csv(featured, full)
    paths[K.REPORT_FULL_DATASET] = full
    return paths
