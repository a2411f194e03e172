"""Grouped summaries.

Each is one ``groupBy`` with built-in aggregates (partial aggregation before
the shuffle, final after), where the dashboard ran a Python lambda per group.
Null group keys are dropped first: the filter reaches the Parquet scan. ``m``
says whether the input is one row per conversation or the cells of a cube.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convolytics import constants as K
from convolytics.functions.labels import accuracy_band, spam_band
from convolytics.functions.measures import Measures, PER_ROW
from convolytics.functions.numeric import round2
from convolytics.schema import Columns, DEFAULT_COLUMNS, DEFAULT_LABELS, Labels


def _non_null(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull())


def topic_summary_report(
    df: DataFrame, cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS, m: Measures = PER_ROW
) -> DataFrame:
    """Per topic the non-null session-id count, resolution and positive
    rates (over all rows of the topic) and mean query / response words, all
    rounded to 2 places; largest topics first."""
    out = _non_null(df, cols.topic).groupBy(cols.topic).agg(
        m.non_null(cols.session_id).alias("total_conversations"),
        round2(m.rate(F.col(cols.status) == labels.resolved)).alias("resolution_rate_pct"),
        round2(m.rate(F.col(cols.sentiment) == labels.positive)).alias("positive_sentiment_pct"),
        round2(m.mean(cols.query_words)).alias("avg_query_words"),
        round2(m.mean(cols.resolution_words)).alias("avg_response_words"),
    )
    return out.orderBy(F.col("total_conversations").desc(), F.col(cols.topic).asc())


def topic_summary(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS, m: Measures = PER_ROW) -> DataFrame:
    """The topic table of the topic tab (A13 without response words)."""
    out = _non_null(df, cols.topic).groupBy(cols.topic).agg(
        m.non_null(cols.session_id).alias("count"),
        round2(m.rate(F.col(cols.status) == labels.resolved)).alias("resolution_rate_pct"),
        round2(m.rate(F.col(cols.sentiment) == labels.positive)).alias("positive_sentiment_pct"),
        round2(m.mean(cols.query_words)).alias("avg_query_words"),
    )
    return out.orderBy(F.col("count").desc(), F.col(cols.topic).asc())


def resolution_rate_by_topic(
    df: DataFrame, k: int = K.TOP_RESOLUTION_RATE, cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS, m: Measures = PER_ROW
) -> DataFrame:
    """Unrounded resolution rate per topic, the ``k`` highest."""
    out = _non_null(df, cols.topic).groupBy(cols.topic).agg(
        m.rate(F.col(cols.status) == labels.resolved).alias("resolution_rate_pct")
    )
    return out.orderBy(F.col("resolution_rate_pct").desc_nulls_last(), F.col(cols.topic).asc()).limit(k)


def accuracy_by_status(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS, m: Measures = PER_ROW) -> DataFrame:
    """A16 + F9: accurate-intent rate per status (null intents stay in the
    denominator), rounded, with its band; status ascending."""
    out = _non_null(df, cols.status).groupBy(cols.status).agg(
        round2(m.rate(F.col(cols.intent) == labels.accurate)).alias("accuracy_pct")
    )
    return out.withColumn("band", accuracy_band("accuracy_pct")).orderBy(cols.status)


def spam_by_sentiment(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS, m: Measures = PER_ROW) -> DataFrame:
    """A17 + F9: spam rate per sentiment, rounded, with its band."""
    out = _non_null(df, cols.sentiment).groupBy(cols.sentiment).agg(
        round2(m.rate(F.col(cols.spam) == labels.spam)).alias("spam_pct")
    )
    return out.withColumn("band", spam_band("spam_pct")).orderBy(cols.sentiment)


def avg_query_words_by_topic(df: DataFrame, k: int = K.TOP_AVG_QUERY_WORDS, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    """Unrounded mean query words per topic, the ``k`` highest."""
    out = _non_null(df, cols.topic).groupBy(cols.topic).agg(m.mean(cols.query_words).alias("avg_query_words"))
    return out.orderBy(F.col("avg_query_words").desc_nulls_last(), F.col(cols.topic).asc()).limit(k)


def avg_resolution_words_by_status(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    """Mean resolution words per status, status ascending."""
    out = _non_null(df, cols.status).groupBy(cols.status).agg(
        m.mean(cols.resolution_words).alias("avg_resolution_words")
    )
    return out.orderBy(cols.status)
