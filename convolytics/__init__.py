"""Conversation analytics on Spark.

Lazy ``DataFrame -> DataFrame`` operators over a table with one row per
chatbot conversation record: schema validation, text features, KPIs,
frequency tables, grouped summaries, cross-tabulations, histograms,
keyword counts, data-quality profiles and CSV/Parquet reports.
"""

from convolytics.schema import Columns, Labels, DEFAULT_COLUMNS, DEFAULT_LABELS

__all__ = ["Columns", "Labels", "DEFAULT_COLUMNS", "DEFAULT_LABELS"]
__version__ = "0.1.0"
