"""Scalar KPIs (A1-A6, A9-A11) and the key-insights row.

Every KPI of a section is one aggregate over one scan; rates divide by all
rows (null labels count as "not equal" and stay in the denominator).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convolytics.functions.labels import drop_off_advice, resolution_advice, sentiment_advice
from convolytics.functions.measures import Measures, PER_ROW
from convolytics.functions.numeric import share
from convolytics.schema import Columns, DEFAULT_COLUMNS, DEFAULT_LABELS, Labels, require_quality_columns


def _distinct(col: str, exact: bool):
    return F.countDistinct(col) if exact else F.approx_count_distinct(col)


def kpi_overview(
    df: DataFrame, cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS, exact: bool = True
) -> DataFrame:
    """A1-A6 in one row: total rows, distinct topics and sessions (nulls not
    counted), resolution, negative-sentiment and drop-off rates.

    ``exact=False`` swaps the two distinct counts for HyperLogLog++ sketches:
    no shuffle of the keys, a few percent error, for very large tables.
    """
    return df.agg(
        F.count(F.lit(1)).alias("total_conversations"),
        _distinct(cols.topic, exact).alias("unique_topics"),
        _distinct(cols.session_id, exact).alias("unique_sessions"),
        PER_ROW.rate(F.col(cols.status) == labels.resolved).alias("resolution_rate_pct"),
        PER_ROW.rate(F.col(cols.sentiment) == labels.negative).alias("negative_sentiment_pct"),
        PER_ROW.rate(F.col(cols.status) == labels.drop_off).alias("drop_off_rate_pct"),
    )


def kpi_quality(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS, m: Measures = PER_ROW) -> DataFrame:
    """A9-A11 in one row: counts and shares (over all rows) of accurate /
    not-accurate intents and not-spam / spam checks; absent labels give 0.
    ``accurate_pct`` is the intent-accuracy KPI."""
    require_quality_columns(df, cols)
    intent, spam = F.col(cols.intent), F.col(cols.spam)
    agg = df.agg(
        m.rows().alias("total_conversations"),
        m.rows(intent == labels.accurate).alias("accurate_count"),
        m.rows(intent == labels.not_accurate).alias("not_accurate_count"),
        m.rows(spam == labels.not_spam).alias("not_spam_count"),
        m.rows(spam == labels.spam).alias("spam_count"),
    )
    t = F.col("total_conversations")
    return agg.select(
        "total_conversations",
        "accurate_count",
        share(F.col("accurate_count"), t).alias("accurate_pct"),
        "not_accurate_count",
        share(F.col("not_accurate_count"), t).alias("not_accurate_pct"),
        "not_spam_count",
        share(F.col("not_spam_count"), t).alias("not_spam_pct"),
        "spam_count",
        share(F.col("spam_count"), t).alias("spam_pct"),
    )


def key_insights(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS, m: Measures = PER_ROW) -> DataFrame:
    """One row with the overall rates, the most common topic and its
    count, the mean query words and three recommendations.

    Two aggregation levels, no join: first per topic (the partial counts the
    KPIs need plus the topic size), then one global row that sums the partial
    counts and picks the top topic as ``min(struct(-n, topic))`` (largest count,
    ties to the smaller topic). The null-topic group feeds the sums but never
    the top topic.
    """
    status, sentiment = F.col(cols.status), F.col(cols.sentiment)
    per_topic = df.groupBy(cols.topic).agg(
        m.rows().alias("rows"),
        m.rows(status == labels.resolved).alias("resolved"),
        m.rows(status == labels.drop_off).alias("drop_off"),
        m.rows(sentiment == labels.negative).alias("negative"),
        m.total(cols.query_words).alias("query_words"),
    )
    top = F.min(F.when(F.col(cols.topic).isNotNull(), F.struct((-F.col("rows")).alias("neg_n"), F.col(cols.topic).alias("t"))))
    total = per_topic.agg(
        F.sum("rows").alias("rows"),
        F.sum("resolved").alias("resolved"),
        F.sum("drop_off").alias("drop_off"),
        F.sum("negative").alias("negative"),
        F.sum("query_words").alias("query_words"),
        top.alias("top"),
    )
    r = F.col("rows")
    out = total.select(
        share(F.col("resolved"), r).alias("resolution_rate_pct"),
        share(F.col("drop_off"), r).alias("drop_off_rate_pct"),
        share(F.col("negative"), r).alias("negative_sentiment_pct"),
        F.col("top.t").alias("top_topic"),
        (-F.col("top.neg_n")).alias("top_topic_count"),
        F.try_divide(F.col("query_words").cast("double"), r.cast("double")).alias("avg_query_words"),
    )
    return out.select(
        "*",
        resolution_advice("resolution_rate_pct").alias("resolution_advice"),
        drop_off_advice("drop_off_rate_pct").alias("drop_off_advice"),
        sentiment_advice("negative_sentiment_pct").alias("sentiment_advice"),
    )
