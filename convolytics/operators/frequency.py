"""Frequency tables (V1-V8) and per-label KPI rows.

Null keys are dropped (the dashboard's frequency tables never show them), the
order is count descending then key ascending, and every total comes from the
already grouped table through a scalar subquery: the input is scanned and
shuffled once, and the totals cost a pass over one row per key. ``m`` says
whether the input is one row per conversation or the cells of a cube.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from convolytics import constants as K
from convolytics.functions.labels import pretty_label
from convolytics.functions.measures import Measures, PER_ROW
from convolytics.functions.numeric import round2, share
from convolytics.schema import Columns, DEFAULT_COLUMNS, DEFAULT_LABELS, Labels


def grouped_counts(df: DataFrame, key: str, m: Measures = PER_ROW) -> DataFrame:
    """``key, n`` for every key value, the null key included (one row).
    Partial aggregation runs before the shuffle, so a hot key costs one row
    per input partition."""
    return df.groupBy(key).agg(m.rows().alias("n"))


def _order(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.col("n").desc(), F.col(key).asc())


def value_counts(df: DataFrame, key: str, m: Measures = PER_ROW) -> DataFrame:
    """V1/V3: ``key, n`` per non-null key, count descending."""
    return _order(df.filter(F.col(key).isNotNull()).groupBy(key).agg(m.rows().alias("n")), key)


def value_counts_with_share(df: DataFrame, key: str, m: Measures = PER_ROW) -> DataFrame:
    """V2/V4/V5: counts plus the pie-chart share, ``n`` over the non-null
    rows (``pct_of_non_null``)."""
    g = grouped_counts(df, key, m)
    non_null_total = g.filter(F.col(key).isNotNull()).select(F.sum("n")).scalar()
    out = g.filter(F.col(key).isNotNull()).select(key, "n", share(F.col("n"), non_null_total).alias("pct_of_non_null"))
    return _order(out, key)


def top_values(df: DataFrame, key: str, k: int, m: Measures = PER_ROW) -> DataFrame:
    """V6/V8: the ``k`` most frequent non-null keys (ties: smaller key first).
    Plans as ``TakeOrderedAndProject``: a top-k per partition, then a merge of
    ``k`` rows per partition."""
    return value_counts(df, key, m).limit(k)


def top_values_with_pct(df: DataFrame, key: str, k: int, m: Measures = PER_ROW) -> DataFrame:
    """V7: top ``k`` keys with ``pct`` = n over all rows, null keys included,
    rounded to 2 places."""
    g = grouped_counts(df, key, m)
    total = g.select(F.sum("n")).scalar()
    top = _order(g.filter(F.col(key).isNotNull()), key).limit(k)
    return _order(top.select(key, "n", round2(share(F.col("n"), total)).alias("pct")), key)


def label_counts_of_rows(df: DataFrame, key: str, m: Measures = PER_ROW) -> DataFrame:
    """Per non-null label ``n`` and ``pct_of_rows`` (n over all rows,
    nulls included) and a display ``label``, count descending."""
    g = grouped_counts(df, key, m)
    total = g.select(F.sum("n")).scalar()
    out = g.filter(F.col(key).isNotNull()).select(
        key,
        pretty_label(key).alias("label"),
        "n",
        share(F.col("n"), total).alias("pct_of_rows"),
    )
    return _order(out, key)


def fixed_label_counts(df: DataFrame, key: str, values: Sequence[str], m: Measures = PER_ROW) -> DataFrame:
    """Count and share (over all rows) of each label in ``values``, in
    that order (``position``), labels that do not occur omitted.

    One aggregate pass computes every count; the one-row result is unpivoted
    with ``inline``, so there is no shuffle beyond the global count.
    """
    c = F.col(key)
    agg = df.agg(
        m.rows().alias("_total"),
        *[m.rows(c == v).alias(f"_n{i}") for i, v in enumerate(values)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).cast("bigint").alias("position"),
                F.lit(v).alias(key),
                F.col(f"_n{i}").alias("n"),
            )
            for i, v in enumerate(values)
        ]
    )
    out = agg.select("_total", F.inline(rows)).filter(F.col("n") > 0)
    return out.select(
        "position",
        key,
        pretty_label(key).alias("label"),
        "n",
        share(F.col("n"), F.col("_total")).alias("pct_of_rows"),
    ).orderBy("position")


# --- the dashboard's tables, with its column names as defaults ----------------


def topic_counts(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return value_counts(df, cols.topic, m)


def status_counts(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return value_counts_with_share(df, cols.status, m)


def sentiment_counts(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return value_counts(df, cols.sentiment, m)


def intent_counts(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return value_counts_with_share(df, cols.intent, m)


def spam_counts(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return value_counts_with_share(df, cols.spam, m)


def topics_top(df: DataFrame, k: int = K.TOP_TOPICS_CHART, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return top_values(df, cols.topic, k, m)


def topics_top_pct(df: DataFrame, k: int = K.TOP_TOPICS_TABLE, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return top_values_with_pct(df, cols.topic, k, m)


def top_topic(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    """V8: the most common topic and its count; an empty table gives no row."""
    return top_values(df, cols.topic, 1, m)


def kpi_status(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, m: Measures = PER_ROW) -> DataFrame:
    return label_counts_of_rows(df, cols.status, m)


def kpi_sentiment(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, labels: Labels = DEFAULT_LABELS, m: Measures = PER_ROW) -> DataFrame:
    return fixed_label_counts(df, cols.sentiment, labels.sentiments, m)
