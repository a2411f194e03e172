"""Every analysis as a named query over the ``sessions`` table derived from
the driver's tables (see ``sources.fixtures``). Each entry takes
``(spark, sf_dir)`` and returns a lazy DataFrame that reads the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from convolytics.operators import crosstab as xt
from convolytics.operators import cube as cb
from convolytics.operators import frequency as fq
from convolytics.operators import grouped as gr
from convolytics.operators import kpis
from convolytics.operators import profile as pf
from convolytics.operators import selection as sl
from convolytics.operators import text as tx
from convolytics.operators.features import add_text_features
from convolytics.operators.topk import top_counts
from convolytics.functions.text import keyword_tokens
from convolytics.schema import DEFAULT_COLUMNS as C
from convolytics.sinks.reports import csv_records, topic_summary_export
from convolytics.sources import fixtures
from convolytics.session import scratch_path
from convolytics.sinks.reports import write_csv
from convolytics.sources.csv import load_sessions, parse_records
from convolytics.sources.excel import make_workbooks, parse_workbooks
from convolytics.sources.head import first_rows

Query = Callable[[SparkSession, str], DataFrame]


def featured_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session table with its four text features."""
    return fixtures.featured_sessions(spark, sf_dir)


def csv_round_trip(sessions: DataFrame) -> DataFrame:
    """Every session as an exported CSV record, read back."""
    return parse_records(csv_records(sessions), sessions.columns)


def csv_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full dataset with its features as CSV files in the
    shared folder, loaded back by byte ranges."""
    path = write_csv(featured_sessions(spark, sf_dir), scratch_path(spark, "full_dataset") + ".csv")
    return load_sessions(spark, path, "csv", split=True)


def xlsx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the full dataset as ``.xlsx`` workbooks, read back."""
    featured = featured_sessions(spark, sf_dir)
    return parse_workbooks(make_workbooks(featured), featured.columns)


def keyword_column(df: DataFrame, column: str) -> DataFrame:
    """One row per keyword of a text column."""
    return df.select(F.explode(keyword_tokens(column)).alias("keyword"))


def _on_cube(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cb.rollups()[name](cb.build_cube(featured_sessions(spark, sf_dir), store=False))

    run.__doc__ = f"``{name}`` as a roll-up of the cube."
    return run


def _on_sessions(op: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(featured_sessions(spark, sf_dir))

    run.__doc__ = op.__doc__
    return run


#: analyses registered a second time as roll-ups of the cube
CUBE_QUERIES = (
    "kpi_overview", "kpi_quality", "kpi_status", "key_insights", "text_stats", "topic_summary_report", "topics_top10_pct",
    "avg_query_words_by_topic", "hist_query_words", "xt_topic_status_top20", "xt_topic_status_margins",
)

QUERIES: dict[str, Query] = {
    # grouped summaries
    "topic_summary_report": _on_sessions(gr.topic_summary_report),
    "topic_summary_export": _on_sessions(topic_summary_export),
    "topic_summary": _on_sessions(gr.topic_summary),
    "resolution_rate_by_topic": _on_sessions(gr.resolution_rate_by_topic),
    "accuracy_by_status": _on_sessions(gr.accuracy_by_status),
    "spam_by_sentiment": _on_sessions(gr.spam_by_sentiment),
    "avg_query_words_by_topic": _on_sessions(gr.avg_query_words_by_topic),
    "avg_resolution_words_by_status": _on_sessions(gr.avg_resolution_words_by_status),
    # scalar KPIs
    "kpi_overview": _on_sessions(kpis.kpi_overview),
    "kpi_quality": _on_sessions(kpis.kpi_quality),
    "kpi_sentiment": _on_sessions(fq.kpi_sentiment),
    "kpi_status": _on_sessions(fq.kpi_status),
    "key_insights": _on_sessions(kpis.key_insights),
    "text_stats": _on_sessions(tx.text_stats),
    # frequencies
    "topic_counts": _on_sessions(fq.topic_counts),
    "status_counts": _on_sessions(fq.status_counts),
    "sentiment_counts": _on_sessions(fq.sentiment_counts),
    "intent_counts": _on_sessions(fq.intent_counts),
    "spam_counts": _on_sessions(fq.spam_counts),
    "topics_top15": _on_sessions(fq.topics_top),
    "topics_top10_pct": _on_sessions(fq.topics_top_pct),
    "top_topic": _on_sessions(fq.top_topic),
    # cross-tabs
    "xt_status_sentiment": _on_sessions(xt.xt_status_sentiment),
    "xt_status_intent": _on_sessions(xt.xt_status_intent),
    "xt_sentiment_spam": _on_sessions(xt.xt_sentiment_spam),
    "xt_intent_spam": _on_sessions(xt.xt_intent_spam),
    "xt_topic_status_top20": _on_sessions(xt.xt_topic_status_top),
    "xt_topic_intent_top10": _on_sessions(xt.xt_topic_intent_top),
    "xt_topic_sentiment_top15": _on_sessions(xt.xt_topic_sentiment_top),
    "xt_topic_status_margins": _on_sessions(xt.xt_topic_status_margins),
    "xt_topic_sentiment_margins": _on_sessions(xt.xt_topic_sentiment_margins),
    "xt_topic_status_margins_long": _on_sessions(
        lambda df: xt.crosstab_long(df, C.topic, C.status, margins=True)
    ),
    # histograms
    "hist_query_words": _on_sessions(tx.hist_query_words),
    "hist_resolution_words": _on_sessions(tx.hist_resolution_words),
    # keywords
    "top_keywords": _on_sessions(lambda df: tx.top_keywords(df, top_n=30)),
    "top_keywords_documents": lambda spark, d: tx.top_keywords(
        fixtures.documents(spark, d).select("text"), "text", top_n=30
    ),
    # data-quality profile
    "profile_shape": _on_sessions(pf.profile_shape),
    # every column but the id, which makes each row its own
    "profile_shape_documents": lambda spark, d: pf.profile_shape(fixtures.documents(spark, d).drop("doc_id")),
    "profile_types": _on_sessions(pf.profile_types),
    "profile_missing": _on_sessions(pf.profile_missing),
    # the text features are added to the ten rows kept, not to the whole table
    "preview": lambda spark, d: pf.preview(fixtures.sessions(spark, d), derive=add_text_features),
    # the full export, written as CSV records and read back
    "csv_round_trip": lambda spark, d: csv_round_trip(fixtures.sessions(spark, d)),
    # the same with the four features, as records and as files
    "full_dataset_export": lambda spark, d: csv_round_trip(featured_sessions(spark, d)),
    "csv_file_round_trip": csv_file_round_trip,
    # and as workbooks, read back
    "xlsx_round_trip": xlsx_round_trip,
    # the featurised table itself
    "text_features": featured_sessions,
    # the cube and roll-ups of it
    "cube_cells": lambda spark, d: cb.build_cube(featured_sessions(spark, d), store=False).cells,
    **{f"cube_{name}": _on_cube(name) for name in CUBE_QUERIES},
    # top-k by a pruning pass, duplicates by a place filter
    "top_keywords_documents_pruned": lambda spark, d: top_counts(
        keyword_column(fixtures.documents(spark, d), "text"), "keyword", 30
    ),
    "profile_shape_filtered": _on_sessions(pf.profile_shape_filtered),
    "profile_shape_filtered_documents": lambda spark, d: pf.profile_shape_filtered(fixtures.documents(spark, d).drop("doc_id")),
    # a continuous column, and rows in file order
    "continuous_stats_lineitem": lambda spark, d: sl.continuous_stats(fixtures.read_table(spark, d, "lineitem"), "l_extendedprice"),
    "first_rows_documents": lambda spark, d: first_rows(spark, f"{d.rstrip('/')}/documents.parquet"),
}
